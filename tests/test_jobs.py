from pyspark.sql import functions as F

from tillroll.plans import jobs
from tillroll.plans.registry import tables
from tillroll.session import scratch_path


def test_report_job_writes_report_and_support(spark, sf_small):
    t = tables(spark, sf_small)
    out = scratch_path(spark, "job-report")
    report = jobs.co_purchase_report_job(t.transactions, t.articles, out, "prod_name", 3)
    back = spark.read.option("header", "true").csv(f"{out}/report")
    assert back.count() == report.count() > 0
    assert "often_purchased" in back.columns and spark.read.parquet(f"{out}/support").count() == report.count()


def test_train_and_score_jobs(spark, sf_small):
    t = tables(spark, sf_small)
    out = scratch_path(spark, "job-forecast")
    paths = jobs.train_forecast_job(t.transactions, t.articles, out, penetration=0.01, lags=7, horizon=14)
    scored = jobs.score_job(paths["model"], paths["scoring_set"], paths["lookup"], f"{out}/scores", spark)
    n_products = spark.read.parquet(paths["lookup"]).count()
    per = spark.read.option("header", "true").csv(f"{out}/scores/by_product").groupBy("product_code").count().collect()
    assert len(per) == n_products > 0 and all(r["count"] == 14 for r in per)
    assert scored.count() == 14 * n_products
    assert scored.where(F.col("forecast") < 0).count() == 0
    assert spark.read.parquet(paths["metrics"]).count() <= n_products
    wide = spark.read.option("header", "true").csv(paths["backtest_wide"])
    assert wide.count() == 14


def test_workers_import_the_package_from_another_folder(sf_small, tmp_path):
    """A session of a process that runs elsewhere, without PYTHONPATH."""
    import os
    import subprocess
    import sys
    from pathlib import Path
    repo = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).config('spark.ui.enabled', 'false')
         .config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate())
for _ in range(2):
    print('rows', e.queries()['adf_search'](spark, {str(sf_small)!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("rows 62") == 2, done.stderr[-2000:]
    assert len(list(tmp_path.glob("tillroll-*.zip"))) == 1
