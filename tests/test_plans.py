"""The plans keep to built-in operators, push filters down and broadcast only the vocabulary."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from icuflow.plans import features
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import read_csv, scan, write_csv
from icuflow.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().toString()


PLAIN = [
    "vitals_first_day", "labs_first_day", "bloodgas_arterial", "gcs_first_day", "caregiver_counts", "window_range_join",
    "point_in_interval_join", "asof_lookback_join", "pair_cooccurrence", "sessionize", "row_number_rank", "quantile_curve", "roc_auc",
    "f1_threshold_sweep", "inverse_cdf_sample", "inverse_cdf_numeric", "matched_donor_noise", "widened_cohort_std",
    "kde_grid", "undersample", "echo_notes",
]


@pytest.mark.parametrize("key", PLAIN)
def test_no_python_rows_and_no_cross_join(spark, sf, key):
    text = plan(entry.queries()[key](spark, sf))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    chart = spark.range(100).select(
        *[F.col("id").alias(c) for c in ("subject_id", "hadm_id", "icustay_id")], F.lit(211).alias("itemid"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("charttime"), F.lit(1.0).alias("valuenum"),
        F.lit(0).alias("error"), F.lit("unused").alias("value"), F.lit(1).alias("cgid"))
    chart.write.parquet(str(tmp_path / "chart"))
    v = {"chartevents": spark.read.parquet(str(tmp_path / "chart")), "icustays": clinical_views(spark, "/root/testdata/sf0.001")["icustays"]}
    text = plan(features.vitals_first_day(v))
    assert "In(itemid" in text and "Not(EqualTo(error,1))" in text
    scans = [line for line in text.splitlines() if "FileScan" in line and "itemid" in line]
    assert scans and all("unused" not in s and "cgid" not in s.split("ReadSchema")[-1] for s in scans)
    assert "value:string" not in text


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 'a,"b" \\ c', None), (2, "x", 2.5)], "id int, t string, v double")
    back = read_csv(spark, write_csv(df, scratch_path(spark, "csv-test")), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_missing_columns_are_named(spark, sf):
    with pytest.raises(ValueError, match="nope"):
        scan(spark, sf, "events", "event_id", "nope")


def test_empty_inputs_give_empty_features(spark, sf):
    v = clinical_views(spark, sf)
    empty = {n: v[n].limit(0) for n in ("icustays", "chartevents", "labevents", "outputevents", "procedureevents_mv")}
    for build in (features.vitals_first_day, features.labs_first_day, features.bloodgas_arterial, features.gcs_first_day,
                  features.urine_output_first_day, features.vent_durations):
        assert build(empty).count() == 0
