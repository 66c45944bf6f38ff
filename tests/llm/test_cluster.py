"""op2 and op3 on several executors that get fewer scan partitions than they have cores."""

import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from inkveil.llm import exact_dedup, lm_scoring
from tests.compare import views

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from inkveil.llm import queries
from inkveil.llm.common import partitions
base = sys.argv[1]
spark = (SparkSession.builder.master("local-cluster[3,2,1200]").config("spark.executor.memory", "1000m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "6").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.files.maxPartitionBytes", "1g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
docs = spark.read.parquet(f"{base}/documents.parquet")
assert partitions(docs) == 4 < spark.sparkContext.defaultParallelism
for k in range(3):
    for name in ("op2_lm_scoring", "op3_exact_dedup"):
        queries.queries()[name](spark, base).write.parquet(f"{base}/{name}-{k}")
spark.stop()
"""


def test_few_partitions_on_many_cores(tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    os.makedirs(tmp_path / "documents.parquet")
    for part in range(4):
        texts = [" ".join(vocabulary[rng.zipf(1.3, 12_000) % 20_000]) for _ in range(120)] + [f"copy {i % 125}" for i in range(500)]
        ids = list(range(part * 1000, part * 1000 + len(texts)))
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / f"documents.parquet/{part}.parquet")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, check=True, timeout=600)
    con = views(str(tmp_path))
    for name, sql in (("op2_lm_scoring", lm_scoring.ORACLE_SQL), ("op3_exact_dedup", exact_dedup.ORACLE_SQL)):
        want = con.sql(sql).df().sort_values("doc_id").reset_index(drop=True)
        for k in range(3):
            got = pq.read_table(str(tmp_path / f"{name}-{k}")).to_pandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
            assert (got == want).all().all(), (name, k)
            if name.startswith("op3"):
                assert set(Counter(got[got["kept"]]["text_sha256"]).values()) == {1}
