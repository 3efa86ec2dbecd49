"""Session helpers: checkpoint folder and SQL settings."""
from grovecast import session


def test_checkpoint_dir_is_kept_once_set(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert first and session.ensure_checkpoint_dir(spark) == first


def test_configure_sets_aqe_and_utc(spark):
    session.configure(spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_materialized_table_lives_in_checkpoint_folder(spark):
    from grovecast.sources import fixtures as fx
    df = fx.materialize(spark.range(5), "probe")
    assert df.count() == 5
    files = df.inputFiles()
    base = session.ensure_checkpoint_dir(spark).replace("file:", "")
    assert files and all(base in f for f in files)
