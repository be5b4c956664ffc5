"""Column -> Column helpers with the reference's semantics: dates and
elapsed time, Python string methods, maths and bins, fixed labels."""
