"""One table of edge cases for each operator and for the whole pipeline: nulls, empty and very long texts, repeated rows, clashing names."""

import hashlib
import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxpanel.llm import packing, quality, segmentations, token_files, toxicity, url_rules, warc
from fluxpanel.llm.exact_dedup import exact_dedup
from fluxpanel.llm.minhash import near_dedup
from fluxpanel.llm.queries import tokenizer_path
from fluxpanel.llm.substring_dedup import substring_dedup

CLASH = "kept string, keep_id string, n_words string, kept_text string, component_id string, sample string, ids string, piece string, start string, score string, grade string"


def fresh(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))


LONG = fresh(20_000, 1)
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (None, fresh(30, 2)), (None, fresh(30, 2)), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG + " end"), (7, "é 漢  x"), (-8, fresh(30, 3))]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, *["clash"] * len(CLASH.split(", "))) for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASH}").repartition(3).cache()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_exact(edges):
    got = by_id(exact_dedup(edges, carry=["doc_id", "kept", "grade"]))
    assert sorted(r["kept"] for r in got[1]) == [False, True] and sorted(r["kept"] for r in got[None]) == [False, True]
    assert got[2][0]["kept"] and not got[3][0]["kept"] and got[3][0]["keep_id"] == 2 and got[4][0]["kept"]
    assert got[5][0]["kept"] and got[6][0]["kept"] and got[5][0]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert got[5][0]["grade"] == "clash"


def test_segmentations(edges, spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = segmentations.sample_segmentations(edges, path)
    got = by_id(rows)
    assert set(got) == {i for i, _ in ROWS} and all(r["roundtrip"] for each in got.values() for r in each)
    for twice in (got[1], got[None]):  # equal rows have equal samples
        samples = sorted((r["sample"], r["ids"]) for r in twice)
        assert samples[::2] == samples[1::2]
    assert [(r["n_pieces"], r["ids"]) for i in (2, 3) for r in got[i]] == [(0, []), (0, [])]
    assert len({tuple(r["ids"]) for r in got[5]}) == 3


def test_toxicity(edges, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, 0), (6, 1, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = by_id(toxicity.toxicity(edges, labels, carry=["doc_id", "kept", "ids"]))
    assert sum(map(len, got.values())) == len(ROWS)
    for twice in (got[1], got[None]):
        assert twice[0] == twice[1]
    assert got[2][0]["p_toxic"] == got[3][0]["p_toxic"] == got[4][0]["p_toxic"]


def test_quality(edges, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, 1), (6, None), (99, 0)], "doc_id bigint, quality int")
    got = by_id(quality.quality_rules(edges, labels))
    assert sum(map(len, got.values())) == len(ROWS)
    for twice in (got[1], got[None]):
        assert twice[0] == twice[1]
    assert all(got[i][0]["n_words"] == 0 and got[i][0]["base_failed"] and not got[i][0]["kept"] for i in (2, 3, 4))
    assert got[5][0]["n_words"] == 20_000 and got[6][0]["n_words"] == 20_001


def test_substrings(edges):
    got = by_id(substring_dedup(edges, carry=["doc_id", "n_words", "kept_text", "grade"], with_text=True))
    assert sorted(r["n_removed"] for r in got[None]) == [0, 30] and [r["n_removed"] for r in got[1]] == [0, 0]
    assert got[5][0]["n_removed"] == 0 and got[5][0]["kept_text"] == LONG and got[5][0]["grade"] == "clash"
    assert got[6][0]["n_removed"] == 20_000 and got[6][0]["kept_text"].split() == ["end"]
    assert got[2][0]["kept_text"] is None and got[3][0]["n_words"] == got[4][0]["n_words"] == 0


def test_near_copies(edges):
    got = by_id(near_dedup(edges, size=3, percent=85))
    assert [(r["component_id"], r["kept"]) for r in got[1]] == [(1, True)] * 2
    assert [(r["component_id"], r["kept"]) for r in got[None]] == [(None, True)] * 2
    assert (got[6][0]["component_id"], got[6][0]["kept"], got[6][0]["n_shingles"]) == (5, False, 19_999)
    assert all(got[i][0]["n_shingles"] == 0 and got[i][0]["kept"] for i in (2, 3, 4))
    assert got[7][0]["n_shingles"] == 1 and got[-8][0]["kept"]


def test_token_files(edges):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = by_id(token_files.read_token_files(token_files.write_token_files(edges, tokenizer_path("word_bpe_49k.json"), "words", end=2, file_docs=4)))
    sizes = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in ROWS}
    assert {i: [r["n_tokens"] for r in each] for i, each in got.items()} == {i: [n] * len(got[i]) for i, n in sizes.items()}
    order = sorted((r["start"], i is not None, i or 0, r["n_tokens"]) for i, each in got.items() for r in each)
    assert [x[1:3] for x in order] == sorted((i is not None, i or 0) for i, _ in ROWS)
    assert all(a[0] + a[3] == b[0] for a, b in zip(order, order[1:], strict=False))


def test_packing(edges):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(edges, tokenizer_path("byte_bpe_50k.json"), "spaces", end=2).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for each in places.values():
        ends = [0]
        for at, n in sorted(each):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 1024
    for i, text in set(ROWS):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        mine = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == len(ids) * [x for x, _ in ROWS].count(i)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]


def test_archive_and_urls(spark):
    url = "http://" + "a." * 300 + "com/en/"
    rows = [(1, url, LONG, "c", "c"), (1, url, LONG, "c", "c"), (None, None, None, "c", "c"), (2, "", "", None, "c"), (3, url, LONG, "c", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, rule string").repartition(3)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()), key=str)
    n = len(LONG)
    assert got == [(0, 0, "response", None), (1, n, "response", None), (1, n, "response", None), (2, 0, "response", None), (3, n, "revisit", 1)]
    judged = url_rules.judge_urls(pages).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in judged if r["url"]) == [(1, "com/", "allow"), (1, "com/", "allow"), (3, "com/", "allow")]
    assert [(r["rule"], r["host"], r["verdict"]) for r in judged if not r["url"]] == [(None, "", "allow")] * 2


def tables(spark, path, rows, labels):
    made = [(i, t, "en", None, len(t) if t else None, "clash", "clash") for i, t in rows]
    spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, kept_text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_runs_on_edge_rows(spark, tmp_path):
    plain = [(100 + i, fresh(30, 1000 + i) + (" vile nasty" if i % 4 == 0 else "")) for i in range(200)]
    rows = [*ROWS, (5, LONG), (9, LONG.replace(" ", "  ", 1)), (10, fresh(40, 4) + " vile nasty"), *plain]
    labels = [(i, 1, int(t.endswith("nasty"))) for i, t in plain] + [(None, 1, 1), (100, None, None), (101, 1, 0)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, labels))
    texts = {1: "a b c d e f", None: fresh(30, 2), 2: None, 4: " \n\t", 5: LONG, 7: ROWS[9][1], -8: ROWS[10][1], **{i: t for i, t in plain if not t.endswith("nasty")}}
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    # 2 stands for 3, 4 is one space by itself, 6 and 9 go with 5
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


@pytest.mark.parametrize("changed,kept", [(4, {1}), (50, {1, 2})])
def test_pipeline_near_stage_with_an_id_of_a_text_and_an_empty_text(spark, changed, kept):
    words = fresh(200, 77).split()
    other = " ".join([*fresh(changed, 78).split(), *words[changed:]])
    rows = [(1, " ".join(words)), (1, ""), (1, None), (2, other)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == kept


def test_pipeline_runs_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0
