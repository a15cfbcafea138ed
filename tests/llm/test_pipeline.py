"""All stages of the pipeline against brute force, each on what the one before it kept."""

import math
import random
import re
import zlib

import corpus_pipeline
import pyarrow as pa
from tokenizers import Tokenizer

from fluxpanel.llm import toxicity
from fluxpanel.llm.queries import tokenizer_path

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus():
    """Toxic texts, exact copies apart from white space, near copies, passages that texts share, and texts of their own."""
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(30), fresh(45), fresh(22)]
    rows, n = [], 0
    for g in range(120):
        base = fresh(rnd.randrange(60, 140))
        if g % 5 == 0:
            base[rnd.randrange(len(base))] = rnd.choice(["vile", "rotten"])
        if g % 4 == 1:
            at = rnd.randrange(len(base))
            base[at:at] = rnd.choice(passages)
        for k in range(rnd.choice([1, 1, 2, 4])):
            copy = list(base)
            if k % 2 == 1:
                for _ in range(rnd.choice([1, 2, 12])):
                    copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(10**6)}"
            rows.append((n, rnd.choice([" ", "\n", "  ", "\t "]).join(copy)))
            n += 1
    rows += [(n, passages[0][0] + " " + " ".join(passages[1])), (n + 1, " ".join(passages[2])), (n + 2, ""), (n + 3, None), (n + 4, "Short one"), (n + 5, "short  ONE"), (n + 6, "é " * 3000)]
    rnd.shuffle(rows)
    return rows


def brute(rows, model):
    """doc_id and text of what the first four stages leave."""
    weight = dict(zip(model["words"].tolist(), model["w"].tolist(), strict=True))

    def toxic(text):
        found = {w.lower() for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text or "") if w}
        z = sum(weight.get(int(toxicity.word_sets(pa.array([w]))[1][0]), 0.0) for w in found)
        return 1 / (1 + math.exp(-(z - model["t"][0]))) > model["cut"]

    kept = sorted(((i, t) for i, t in rows if not toxic(t)), key=lambda r: r[0])
    seen, unique = set(), []
    for i, t in kept:
        key = SPACE.sub(" ", t or "")
        if key not in seen:
            seen.add(key)
            unique.append((i, t))
    sets = []
    for _, t in unique:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(unique)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    firsts = [r for k, r in enumerate(unique) if find(k) == k]
    windows, out = set(), []
    for i, t in firsts:
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            run = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if run in windows else set()
            windows.add(run)
        if gone and len(gone) == len(w):
            continue
        if gone:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            ends = [s for s, _ in spans[1:]] + [len(t)]
            t = t[: spans[0][0]] + "".join(t[s:e] for k, ((s, _), e) in enumerate(zip(spans, ends, strict=True)) if k not in gone)
        out.append((i, t))
    return len(kept), len(unique), len(firsts), out


def test_all_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(bool(re.search("vile|rotten", t or "")))) for i, t in rows if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    models, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = brute(rows, models[0])
    left = counts[3]
    assert len(rows) > counts[0] > counts[1] > counts[2] > len(left)
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_doc) == sorted(i for i, _ in left)
    for i, t in left:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(by_doc[i]) == 1)
    for each in by_sequence.values():
        end = 0
        for at, n in sorted(each):
            assert at == end
            end += n
        assert end <= 1024
