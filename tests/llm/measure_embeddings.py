"""Recall and bytes of the vector search on 51,282 vectors of 64 floats: python -m tests.llm.measure_embeddings [vectors].

Vectors around a common direction of norm 0, 0.6 and 0.9, vectors whose spread falls from axis to axis, and the check tool's
own; a tenth of each are near copies of others. Recall is that of links, against brute force in blocks.
"""

import sys
import tempfile
import time

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from sitewright.llm import embeddings

N = int(sys.argv[1]) if len(sys.argv) > 1 else 51_282


def sets():
    rng = np.random.default_rng(1)
    unit = embeddings.unit_vectors

    def with_copies(v):
        k = len(v) // 10
        return unit(np.concatenate([v[:-k], v[:k] + 0.4 * v[:k].std() * rng.standard_normal((k, v.shape[1]))])).astype(np.float32)

    direction = unit(rng.standard_normal((1, 64)))
    for norm in (0.0, 0.6, 0.9):
        yield f"common direction of {norm}", with_copies(norm * direction + np.sqrt(1 - norm**2) * unit(rng.standard_normal((N, 64))))
    yield "falling spread", with_copies(rng.standard_normal((N, 64)) * 0.95 ** np.arange(64))
    try:
        table = pq.read_table("/root/testdata/check_l/embeddings.parquet", columns=["embedding"])["embedding"].combine_chunks()
        yield "check_l", table.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
    except (OSError, ValueError):
        pass


def links(v):
    u = embeddings.unit_vectors(v)
    return np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(1) - 1 for a in range(0, len(u), 1000)])


def written(spark):
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def main():
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{folder}").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, v in sets():
        path = f"{folder}/{name.replace(' ', '-')}.parquet"
        import pyarrow as pa

        pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": list(v)}), path)
        index = embeddings.learn(embeddings.unit_vectors(v[:20_000]), len(v), 0.9)
        start, before = time.time(), written(spark)
        got = np.array([r.n_links for r in embeddings.near_vectors(spark.read.parquet(path)).select("vec_id", "n_links").orderBy("vec_id").collect()])
        took, moved, want = time.time() - start, written(spark) - before, links(v)
        shape = f"{index.tables} tables of {index.width} bits" if index else "all compared"
        print(f"{name}: {len(v)} vectors, {shape}, {got.sum() // 2} of {want.sum() // 2} links (recall {got.sum() / max(1, want.sum()):.4f}), shuffled {moved / len(v) / v.nbytes * len(v):.2f} x the vectors' bytes, {took:.0f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
