"""Stage tables: every stage is written once as a versioned, schema-checked
table and can be read back."""

from closurelens.plans.handoffs import write_stage_tables


def test_stage_tables(spark, tmp_path):
    out = write_stage_tables(spark, "/root/testdata/sf0.001", str(tmp_path / "stages"))
    assert set(out) >= {"names_clean", "affiliation", "store_counts", "gold_panel", "clusters", "risk_scores"}
    for name, path in out.items():
        assert spark.read.parquet(path).count() > 0, name
    # versioned: a second run writes new folders, never over the first
    again = write_stage_tables(spark, "/root/testdata/sf0.001", str(tmp_path / "stages"))
    assert all(again[k] != out[k] for k in out)
