"""Properties from the test strategy: segments partition the customers,
percentages of a total add to 100, idempotent cleaning stays idempotent,
one view row per person."""

import pytest
from pyspark.sql import functions as F

from revlens.plans import cleaning as C
from revlens.plans import notebook_analyses as nb
from revlens.plans import sql_analyses as q


def test_segments_partition_people(small_tables):
    people = q.rfm_scores(small_tables).count()
    seg = q.qry_01_rfm_segments(small_tables).agg(F.sum("customer_count")).collect()[0][0]
    assert seg == people
    view = q.qry_11_rfm_customer_segments(small_tables)
    assert view.count() == people == view.select("customer_unique_id").distinct().count()
    nb_seg = nb.ana_01_rfm_quantile(small_tables).agg(F.sum("customers")).collect()[0][0]
    assert nb_seg == nb.rfm_quantile_scores(nb.notebook_tables(small_tables)).count()


def test_percentages_of_total_add_to_100(small_tables):
    total = q.qry_03_churn_buyer_type(small_tables).agg(F.sum("pct_of_total")).collect()[0][0]
    assert total == pytest.approx(100.0, abs=0.02)  # each share is rounded to 2 places


def test_payment_cleaning_is_idempotent(small_tables):
    once = C.clean_payments(small_tables["payments"])
    twice = C.clean_payments(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_aov_segments_cover_people(small_tables):
    bins = nb.ana_09_aov_bins(small_tables)
    assert [r.segment for r in bins.collect()] == ["Low", "Medium", "High"]
    people = nb._orders_customers(nb.notebook_tables(small_tables), ("order_id",))
    assert bins.agg(F.sum("customers")).collect()[0][0] <= \
        people.select("customer_unique_id").distinct().count()
