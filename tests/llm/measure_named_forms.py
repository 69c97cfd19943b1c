"""What the forms that op5 and op8 are named after would cost: python -m tests.llm.measure_named_forms [folder of tables].

First round of a distributed difference cover: the triples at sampled places of all texts, sorted over the cluster. Later
rounds join the names back and recurse on two thirds of the places. Automata of whole reference shards: the build of one,
its size, and documents streamed through it; each document meets every shard.
"""

import resource
import sys
import tempfile
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitewright.llm.automata import SuffixAutomaton

FOLDER = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"


def first_round(spark) -> tuple[float, float]:
    """MB of text, MB written by the shuffle that sorts its sampled triples."""

    def triples(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode() + b"\0\0", np.uint8).astype(np.int64)
                at = np.arange(len(data) - 2)
                at = at[at % 3 != 0]
                yield pa.RecordBatch.from_arrays([pa.array(data[at] << 16 | data[at + 1] << 8 | data[at + 2]), pa.array((doc << 24) + at)], names=["triple", "place"])

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.mapInArrow(triples, "triple long, place long").repartitionByRange(16, "triple").sortWithinPartitions("triple").write.format("noop").mode("overwrite").save()
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    written = sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6, written / 1e6


def whole_automaton(words: int = 100_000) -> None:
    texts = [(t or "").encode().split() for t in pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"])["text"].to_pylist()]
    codes: dict[bytes, int] = {}
    code = lambda w: [codes.setdefault(x, len(codes)) for x in w]
    shard, n = [], 0
    for t in texts:
        if n > words:
            break
        shard.append(code(t))
        n += len(t)
    rest = [code(t) for t in texts[len(shard) :]]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    automaton = SuffixAutomaton()
    for t in shard:
        automaton.add(t)
    built = time.time() - start
    size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    start = time.time()
    for t in rest:
        automaton.matching_statistics(t)
    took, n_rest = time.time() - start, sum(map(len, rest))
    print(f"shard of {n} words: {built:.2f} s to build, {len(automaton.next)} states, {size / 1024:.0f} MB; {n_rest} words streamed in {took:.2f} s, {took / n_rest * 1e6:.2f} us a word")


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
    text, shuffled = first_round(session)
    print(f"first round of the difference cover: {shuffled:.0f} MB shuffled for {text:.1f} MB of text, {shuffled / text:.1f} times")
    session.stop()
    whole_automaton()
