"""The pipeline's stages: columns, and that each stage's decisions take effect."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import INSULTS, classes, naive_hits, prose, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from umbra.llm import decontaminate, mixing
from umbra.llm.queries import QUERIES, tokenizer_file
from umbra.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        new.count()
        out.append((name, docs, new))
        docs = new
    return out


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    assert all(new.schema == docs.schema for _, docs, new in stages[:-1])
    assert stages[-1][2].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_each_stage_keeps_a_part(stages):
    for _, docs, new in stages[:-1]:
        assert new.count() <= docs.count() and new.join(docs, "doc_id", "left_anti").count() == 0
    assert stages[-1][2].count() == stages[-1][1].count()


def test_decontaminated(spark, stages):
    left = decontaminate.contamination(stages[2][2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.where(decontaminate.contaminated()).count() == 0


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A small folder of tables with toxic, copied and contaminated documents whose ids are known."""
    rng = random.Random(41)
    folder, docs, kinds = tmp_path_factory.mktemp("sf"), [], {}
    bench = [(i, prose(rng, 30)) for i in range(5)]
    copied = [prose(rng, 60) for _ in range(4)]
    for i in range(240):
        ws, kind = prose(rng, 60).split(), ("toxic" if i % 6 == 0 else "copy" if i % 6 == 1 and i < 100 else "dirty" if i % 12 == 2 else "clean")
        if kind == "toxic":
            at = rng.randrange(len(ws))
            ws = ws[:at] + INSULTS + ws[at:]
        elif kind == "copy":
            ws = copied[i % 4].split()
            if i % 3:
                ws[rng.randrange(60)] = "changed"
        elif kind == "dirty":
            ws = ws[:20] + bench[i % 5][1].split()[3:25] + ws[20:]
        docs.append((i, " ".join(ws), "en", f"src{i % 3}", len(" ".join(ws))))
        kinds[i] = kind
    docs += [(1000, None, "en", "src0", 0), (1001, "", "en", None, 0), (1002, " \n", None, "src1", 2), (None, "alone here", "en", "src1", 10)]
    labels = [(i, int(i % 4 != 3), int(k == "toxic")) for i, k in kinds.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), kinds, bench


def test_run_equals_plain_stages(spark, planted):
    folder, kinds, bench = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, rows = [], docs
    for _, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, folder), "stage")
        out.append(rows)
    texts = [{r.doc_id: r.text for r in x.collect()} for x in [docs, *out[:-1]]]
    ids = [set(x) for x in texts]
    # toxicity: exactly the planted ones go
    assert ids[0] - ids[1] == {i for i, k in kinds.items() if k == "toxic"}
    # near-duplicates: the least id of each class by brute force stays; ids that are null stay
    sets = {i: shingles(t, 5) for i, t in texts[1].items() if i is not None}
    want = classes(sets)
    assert ids[2] == {i for i in sets if want[i] == i} | {None} and len(ids[2]) < len(ids[1])
    # decontamination: the contract's rule by plain Python
    bad = {i for i, t in texts[2].items() if (lambda n, h, _: h > 0 and 20 * h >= n)(*naive_hits(t, bench))}
    assert ids[3] == ids[2] - bad and bad == {i for i, k in kinds.items() if k == "dirty"}
    # mixing: the fitted rates and the coin
    labels = corpus_pipeline.domains(spark, folder)
    found = mixing.mixed(out[2], mixing.fit(docs, labels, ["clean", "low"]), corpus_pipeline.WEIGHTS, most=1.0)
    coin = {r.doc_id: r.c for r in out[2].selectExpr("doc_id", "pmod(xxhash64(doc_id, xxhash64(coalesce(text, '')), 0), 1073741824) / 1073741824D as c").collect()}
    assert ids[4] == {r.doc_id for r in found.collect() if r.rate + coin[r.doc_id] >= 1}
    # token shards: the library's ids in ascending order
    t, at = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in out[-1].collect()}
    for i in sorted(texts[4], key=lambda i: (i is not None, i)):
        enc = [*t.encode(texts[4][i] or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(enc), zlib.crc32(np.array(enc, "<u4").tobytes()))
        at += len(enc)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, out[-1].collect()), key=repr)


def test_stages_on_odd_tables(spark, planted):
    """Empty tables, null and repeated ids, and columns beside the usual ones."""
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)).withColumn("__text", F.lit("x"))
    few = docs.where("doc_id < 6 or doc_id >= 1000 or doc_id is null")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
        again = stage(spark, few.unionByName(few), folder)
        assert again.count() > 0 and (name == "token_shards" or again.columns == docs.columns)
