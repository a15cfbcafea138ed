"""WARC archives and URL rules against brute force, the pipeline's stages, and the guard."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import queries, url_rules, warc

PAGES = "page_id bigint, url string, html string, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def site(n, seed=0):
    rnd = random.Random(seed)
    bodies = ["x" * rnd.randrange(90, 130) for _ in range(6)] + ["é" * 50, "é" * 49, "", None]
    return [(i, rnd.choice(["http://hot.example.com/a", f"https://h{rnd.randrange(20)}.example.org/p?q={i}#f", None, "no scheme", f"http://A.B:80/{i}\n"]), rnd.choice([*bodies, f"unique {i} " * 20])) for i in range(n)]


def test_records_round_trip(spark):
    rows = site(400) + [(1000, "http://long", "z" * 400_000)]
    got = {r["page_id"]: r for r in warc.archive_and_read(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    raw = {i: (h or "").encode() for i, _, h in rows}
    for i, body in raw.items():
        first = min(j for j, b in raw.items() if b == body) if len(body) >= 100 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))


def test_lookup_finds_all_captures_of_a_key(spark):
    rows = site(300, 1)
    entries = warc.write_archive(pages(spark, rows), file_bytes=4000)
    index = warc.write_index(entries, block=7)
    hot = warc.url_key("http://hot.example.com/a")
    wanted = spark.createDataFrame([(hot, None), (hot, None), ("absent)", None)], "key string, id bigint")
    found = {r["id"] for r in warc.lookup(index, wanted).collect()}
    assert found == {i for i, u, _ in rows if u == "http://hot.example.com/a"}
    read = warc.read_records(warc.lookup(index, wanted)).collect()
    assert {r["page_id"] for r in read} == found and len(read) == len(found)


def test_entries_without_url_and_id_lie_in_several_index_files(spark):
    rows = [(None, None, f"body {i}") for i in range(400)] + [(7, "http://a/", "x"), (7, "http://a/", "x")]
    entries = warc.write_archive(pages(spark, rows), file_bytes=2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.write_index(entries, block=5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p for k, i, p in index if k == ""}) > 1
    wanted = spark.createDataFrame([("", None), ("a)/", 7), (None, 7), (None, None)], "key string, id bigint")
    found = warc.lookup(index, wanted).collect()
    assert sorted((r["key"], r["id"]) for r in found) == [("", None)] * 400 + [("a)/", 7)] * 2
    assert len({(r["file"], r["offset"]) for r in found}) == 402
    assert warc.lookup(index, wanted.limit(0)).count() == 0 and warc.read_records(warc.lookup(index, wanted.limit(0))).count() == 0
    assert warc.lookup([], wanted).count() == 0


def test_repeated_rows_null_ids_and_empty_table(spark):
    body = "b" * 200
    rows = [(2, "http://a/", body), (2, "http://a/", body), (None, "http://a/", body), (None, None, None), (3, "http://b/", body)]
    got = warc.archive_and_read(pages(spark, rows)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"]) == [(0, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 2)]
    assert len(got) == 5
    assert warc.archive_and_read(pages(spark, rows).limit(0)).count() == 0


def test_keys_and_broken_records():
    assert warc.url_key("HTTP://u@WWW.Example.com:8080/P?q#f") == "com,example,www:8080)/P?q"
    assert warc.url_key("http://a") == "a)/" and warc.url_key(None) == "" and warc.url_key("x y") == ")x y"
    good = warc.record(1, "http://a/\r\n", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    headers, payload = warc.parse(good)
    assert payload == b"payload" and headers["WARC-Target-URI"] == "http://a/%0D%0A"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"payload", "0" * 64, None, False))


URLS = [
    None, "", "no scheme", "http://example.com", "http://example.com/", "https://www.Example.com/en/1", "http://example.com/en/1", "http://blog.example.com/en/x", "http://a.net/es/", "http://net/fr/x?y",
    "http://notexample.com/en/", "http://a.org/en/", "http://spam-farm.example.org/x", "http://x.spam-farm.org", "http://spamfarm.org/", "http://a.org/free-money", "http://a.org/free-moneys", "http://a.org/x?utm_source=feed&ref=x",
    "http://a.org/x?utm_source=feeds&ref=x", "http://a.org/download/b/c.EXE?z", "http://CASINO.org/", "a://b://net/es/", "http://a.net?/es/", "http://a.net#/fr/", "http://big-casino-x.org/\nq",
    "http://a.org/en/3?page=2&ref=x", "http://a.org/en/3?PAGE=2", "http://a.org/en/3?page=x", "http://m.adult-x.org/",
]


def verdict(url):
    m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[2]) if m else ""
    path = m[3] if m else ""
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    return host, path, None, "block" if url is not None and any(re.search(p, low) for p, _ in url_rules.PATTERNS) else "allow"


def test_verdicts_equal_all_rules_run(spark):
    df = spark.createDataFrame([(i % len(URLS), u, "clash") for i, u in enumerate(URLS + URLS[:7])], "page_id bigint, url string, rule string")
    rows = url_rules.judge_urls(df).collect()
    assert len(rows) == len(URLS) + 7
    for r in rows:
        u = URLS[r["page_id"]]
        assert tuple(r[c] for c in ("host", "path", "rule", "verdict")) == verdict(u), u
    assert {r["by"] for r in rows} == {"host", "pattern", "default"}
    assert url_rules.judge_urls(df.limit(0)).count() == 0
    assert url_rules.judge_urls(df, host_rules=[], patterns=[]).filter("verdict = 'block'").count() == 0


def test_thousands_of_rules_equal_running_all(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "shop", "news", "x1"]) + str(rnd.randrange(900))
    patterns = [(f"[/.]{(w := word())}-{(v := word())}([/.?]|$)", [w, v]) for _ in range(4000)] + [(f"[?&]{(w := word())}=[0-9]+", [w]) for _ in range(1000)]
    hosts = [(".".join(word() for _ in range(rnd.randrange(1, 4))), rnd.choice(["/", "/en/", "/en/x"]), rnd.choice(["allow", "block"])) for _ in range(2000)]
    urls = []
    for _ in range(600):
        p, (h, path, _v) = rnd.choice(patterns)[1], rnd.choice(hosts)
        urls.append(rnd.choice([f"http://{h}{path}1", f"http://w.{h}/en/", f"https://q.org/{'-'.join(p)}/z", f"https://{'-'.join(p)}.org/z", f"http://q.net/?{p[0]}=7", f"http://q.net/{p[0]}"]))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = url_rules.judge_urls(df, host_rules=spark.createDataFrame(hosts, "host string, path string, verdict string"), patterns=spark.createDataFrame(patterns, "pattern string, tokens array<string>")).collect()
    compiled = [re.compile(p) for p, _ in patterns]
    for r in rows:
        m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)", urls[r["page_id"]])
        fits = [(len(h + p), h + p, v) for h, p, v in hosts if (m[2] == h or m[2].endswith("." + h)) and m[3].startswith(p)]
        want = max(fits)[1:] if fits else (None, "block" if any(p.search(urls[r["page_id"]]) for p in compiled) else "allow")
        assert (r["rule"], r["verdict"]) == want, urls[r["page_id"]]
    assert len({r["verdict"] for r in rows if r["rule"] is None}) == 2


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 20_000 + "com/en/", "http://q.org/" + "b-" * 50_000 + "/free-money", "x" * 200_000]
    began = time.time()
    rows = {r["url"]: r for r in url_rules.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [rows[u]["verdict"] for u in urls] == ["allow", "block", "allow"] and rows[urls[0]]["rule"] == "com/"
    assert time.time() - began < 30


def test_rules_that_cannot_be_filed(spark):
    df = spark.createDataFrame([("http://a/",)], "url string")
    for tokens in ([], ["a-b"], ["A"]):
        with pytest.raises(ValueError):
            url_rules.judge_urls(df, patterns=[("x", tokens)])
    with pytest.raises(ValueError):
        url_rules.judge_urls(df, patterns=spark.createDataFrame([("x", None)], "pattern string, tokens array<string>"))


def test_tokens_that_are_not_in_every_match_narrow_a_pattern(spark):
    urls = ["http://a.org/shop", "http://a.org/shopping", "http://a.org/x", None]
    rows = url_rules.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), host_rules=[], patterns=[("shop", ["shop"])]).collect()
    assert {r["url"]: r["verdict"] for r in rows} == {urls[0]: "block", urls[1]: "allow", urls[2]: "allow", None: "allow"}


def test_patterns_are_filed_under_the_rarest_token(spark):
    df = spark.createDataFrame([("http://spam.a/",), ("http://spam.b/",), ("http://farm.c/",)], "url string")
    index = url_rules.rarest_tokens(df, "url", url_rules.pattern_table(spark, [("spam-farm", ["spam", "farm"]), ("none", ["spam", "none"])]))
    assert {tuple(r) for r in index.collect()} == {("spam-farm", "farm"), ("none", "none")}


def test_patterns_decide_pages_without_a_host_rule(spark):
    rows = queries.op9_url_filters(spark, "/root/testdata/sf0.01").filter("rule is null")
    assert rows.filter("verdict = 'block'").count() > 0 and rows.filter("verdict = 'allow'").count() > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, base = fresh(60), fresh(120)
    near = base.split()
    near[60] = "changed"
    texts = {0: fresh(80), 1: base, 2: base.replace(" ", "  "), 3: " ".join(near), 4: fresh(30) + " " + passage, 5: passage + " " + fresh(30), 6: None, 7: "", 8: fresh(50) + " vile rotten nasty"}
    texts |= {100 + i: fresh(30) + (" vile nasty" if i % 4 == 0 else "") for i in range(400)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    clean = {0, 1, 2, 3, 4, 5, 6, 7, *(100 + i for i in range(400) if i % 4)}
    assert set(seen["toxicity"]) == clean
    assert set(seen["exact_dedup"]) == clean - {2, 7}
    assert set(seen["near_dedup"]) == clean - {2, 3, 7}
    assert set(seen["substring_dedup"]) == clean - {2, 3, 7}
    assert passage in seen["substring_dedup"][4]["text"] and passage not in seen["substring_dedup"][5]["text"]
    assert seen["substring_dedup"][5]["n_chars"] == len(seen["substring_dedup"][5]["text"])
    assert set(seen["packing"]) == clean - {2, 3, 7}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_bounded_sample(spark):
    from fluxpanel.llm.shared import bounded_sample

    df = spark.range(5000)
    order = F.xxhash64("id")
    assert bounded_sample(df, 100, order, 5000).count() == 100
    want = {r["id"] for r in df.orderBy(order).limit(100).collect()}
    assert {r["id"] for r in bounded_sample(df, 100, order, 5000).collect()} == want


def test_many_rules_of_one_host_equal_all_rules_in_turn(spark):
    rnd = random.Random(12)
    segment = lambda: rnd.choice(["a", "b", "cd", "efg", "long-name", str(rnd.randrange(40))])
    rules = {("big.org", "/" + "/".join(segment() for _ in range(rnd.randrange(1, 7))), rnd.choice(["allow", "block"])) for _ in range(260_000)}
    rules = list(rules)[:100_000] + [("", "", "block"), ("x.big.org", "/a", "allow"), ("org", "/", "block"), ("big.org", "/a", None), (None, "/", "allow")]
    assert len(rules) > 90_000
    urls = ["http://" + rnd.choice(["big.org", "www.big.org", "x.big.org", "other.org", "org", "q.net"]) + "/" + "/".join(segment() for _ in range(rnd.randrange(0, 8))) + rnd.choice(["", "?q=1", "/"]) for _ in range(3000)]
    urls += urls[:50] + ["", "no scheme", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["by"]) for r in url_rules.judge_urls(df, host_rules=table, patterns=[]).collect()}
    assert len(got) == len(urls)
    held = {}
    for h, p, v in rules:
        if h is not None and v is not None:
            held[h, p] = max(v, held.get((h, p), ""))
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[2].lower(), m[3]) if m else ("", "")
        labels = host.split(".")
        fits = [(len(h) + n, h + path[:n], held[h, path[:n]]) for k in range(len(labels)) for h in [".".join(labels[k:])] for n in range(len(path) + 1) if (h, path[:n]) in held]
        want = (*max(fits)[1:], "host") if fits else (None, "allow", "default")
        assert got[i] == want, u
