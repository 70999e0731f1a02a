"""The pipeline's stages on small tables, each against a plain version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from riftline.llm import jaccard, mixing, secrets, tokens, toxicity, workspace

from .common import SCHEMA, clashing, odd
from .test_jaccard import brute

DATA = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_terms(text):
    """Distinct buckets of a text's words and their beginnings, one text at a time."""
    import pyarrow as pa

    (_, counts, buckets), = toxicity.terms(pa.array([text], pa.string()))
    return buckets.tolist()


def plain_score(machine, text):
    at = {t: k for k, t in enumerate(machine.terms.tolist())}
    on = [at[b] for b in plain_terms(text) if b in at] if text else []
    z = machine.bias + sum(machine.linear[k] for k in on) + sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(on) for b in on[:i])
    return 1 / (1 + np.exp(-z))


def plain_passes(rows):
    """(row, passes) of the mix: sources in order share 150 percent by weight, at most twice their words."""
    size = {k: len(WORD.findall(r.text or "")) for k, r in enumerate(rows)}
    sources = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    words = {s: sum(size[k] for k, r in enumerate(rows) if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(words.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * words[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
            free.discard(s)
    order = sorted(size, key=lambda k: (hashlib.md5(f"curriculum:{'' if rows[k].doc_id is None else rows[k].doc_id}".encode()).hexdigest(), size[k]))
    start, out = dict.fromkeys(sources, 0), {}
    for k in order:
        s = rows[k].source
        out[k] = sum(start[s] + size[k] / 2 + p * words[s] < target[s] for p in (0, 1))
        start[s] += size[k]
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, workspace.stage(step(spark, docs, DATA), f"test-{name}")
        seen[name] = before, docs
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
    before, after = seen["toxicity"]
    machine = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if plain_score(machine, r.text) < 0.5)
    before, after = seen["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {c for _, c in groups.values()}
    before, after = seen["secrets"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert secrets.scan(r.text) == ([], []) and r.text == secrets.redact(old[r.doc_id])
    before, after = seen["mixing"]
    rows = before.collect()
    want = Counter()
    for k, n in plain_passes(rows).items():
        want[rows[k].doc_id] += n
    assert Counter(r.doc_id for r in after.collect()) == +want
    before, after = seen["packing"]
    encode = tokens.encoder(tokens.default_path()).tokenizer.encode
    pieces = Counter()
    for r in before.collect():
        ids = np.array([*encode(r.text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            pieces[r.doc_id, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) <= 1.05 * sum(r.length for r in rows) / 4096 + 1


ODD_STAGE = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, " \n\t ", "en", None, 4), (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, "word " * 30_000, "de", "b", 150_000), (3, "password = hunter2hunter2", None, "b", 25)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    step = dict(corpus_pipeline.STAGES)[name]
    docs = clashing(odd(spark, ODD_STAGE)).withColumnRenamed("url", "_row_key")
    out = step(spark, docs, DATA)
    rows = out.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.piece == 0 and r.doc_id is None) == 2 and len({r.sequence_id for r in rows}) >= 8
    else:
        assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text, r._row_key) for r in rows)
        texts = Counter((i, t, "taken") for i, t, *_ in ODD_STAGE)
        if name == "near_duplicates":
            texts[1, "one two three four five six", "taken"] = 1
        elif name == "secrets":
            del texts[3, "password = hunter2hunter2", "taken"]
            texts[3, "[SECRET]", "taken"] = 1
        if name != "mixing":
            assert got == texts
        else:
            assert set(got) <= set(texts) and got[2, "word " * 30_000, "taken"] in (1, 2)
    empty = step(spark, spark.createDataFrame([], SCHEMA), DATA)
    assert empty.count() == 0


def test_run_is_the_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def documents(*rows):
    return [(i, t, "en", "a", len(t or "")) for i, t in rows]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{j}" for j in range(12)) for k in "abc")
    rows = documents((None, a), (None, a), (7, a), (7, a), (None, b), (None, b), (3, ""), (3, ""), (None, None), (7, c))
    out = jaccard.one_of_each(odd(spark, rows).repartition(3))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == {(7, a): 1, (None, b): 1, (3, ""): 2, (None, None): 1, (7, c): 1}


def test_mixing_of_null_and_repeated_ids(spark):
    rows = documents(*[(None, f"null {k} x y z") for k in range(8)], *[(5, f"five {k} x y z") for k in range(8)], *[(9, "all alike here")] * 4)
    docs = odd(spark, rows)
    out = mixing.mixed_documents(docs)
    taken = Counter(r.text for r in out.collect())
    assert out.columns == docs.columns
    # each text as often as its row is planned, and by pass: 1.5 times all words
    assert sum(taken.values()) == sum(r.passes for r in mixing.mix(docs).collect())
    assert all(n <= 2 for t, n in taken.items() if t != "all alike here") and taken["all alike here"] <= 8
    assert any(t.startswith("null") for t in taken) and abs(sum(len(t.split()) * n for t, n in taken.items()) - 1.5 * 92) <= 5
