"""Near copies by fingerprint and shingles, and operators that carry other columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm import decontaminate, mixing, similar, suffixdedup, urlfilter

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "rt", "sh")]


def family(rng, base: list[str], copies: int, edits: int) -> list[str]:
    """Copies of a text with so many words replaced, dropped or put in at random places."""
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(edits):
            at = rng.randrange(len(words))
            kind = rng.random()
            words[at : at + (kind < 0.7)] = [rng.choice(VOCABULARY)] if kind < 0.4 or kind > 0.7 else []
        out.append(" ".join(words))
    return out


def shingled(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def grouped(spark, texts: list, **options) -> dict:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return {r.doc_id: r.root for r in similar.similar_groups(docs, **options).collect()}


def test_recall_and_no_false_links(spark):
    """Pairs at 0.8 or more, most of them barely: at least 0.9 are found, and no two texts are
    put together without a chain of such pairs."""
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(100, 400))]
        texts += [" ".join(base), *family(rng, base, 2, max(1, len(base) // rng.choice([45, 50, 60, 100])))]
    sets = [shingled(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if b // 3 == a // 3 and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 150
    root = grouped(spark, texts)
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in pairs:
        parent[top(a)] = top(b)
    members = {}
    for i, r in root.items():
        members.setdefault(r, set()).add(top(i))
    assert all(len(tops) == 1 for tops in members.values())


@pytest.mark.parametrize("run", [16, 2])
def test_family_is_one_group(spark, run):
    """Many copies of one text, similar to it and not to each other, also in runs beyond the limit."""
    rng = random.Random(12)
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    texts = [" ".join(base), *family(rng, base, 150, 5), *(" ".join(rng.choice(VOCABULARY) for _ in range(300)) for _ in range(20))]
    sets = [shingled(t) for t in texts]
    near = [i for i in range(151) if jaccard(sets[0], sets[i]) >= 0.8]
    assert len(near) > 100 and jaccard(sets[near[1]], sets[near[2]]) < 0.9
    root = grouped(spark, texts, run=run)
    assert sum(root[i] == root[0] for i in near) >= 0.95 * len(near)
    assert len({root[i] for i in range(151, 171)}) == 20


@pytest.mark.parametrize("cell", [similar.CELL, 8])
def test_links_that_no_hub_has(spark, monkeypatch, cell):
    """Members of a family that are similar to each other and not to its middle, met in long runs only."""
    monkeypatch.setattr(similar.rest, "__defaults__", (cell,))
    rng = random.Random(16)
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    texts = [" ".join(base), *family(rng, base, 60, 4)]
    for _ in range(10):
        far = family(rng, base, 1, 14)[0]
        texts += [far, *family(rng, far.split(" "), 2, 1)]
    sets = [shingled(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    apart = [(a, b) for a, b in links if b > 60 and not any(jaccard(sets[x], sets[y]) >= 0.8 for x in range(61) for y in (a, b))]
    assert len(apart) >= 20
    root = grouped(spark, texts, run=1)
    assert sum(root[a] == root[b] for a, b in apart) >= 0.95 * len(apart)
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        parent[top(a)] = top(b)
    members = {}
    for i, r in root.items():
        members.setdefault(r, set()).add(top(i))
    assert all(len(tops) == 1 for tops in members.values())


def test_few_pairs_of_a_family_of_strangers(spark, monkeypatch):
    """Of a long run whose texts are mostly similar to no other, few more pairs are verified than hold."""
    rng = random.Random(17)
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    texts = family(rng, base, 120, 14)
    texts += [family(rng, t.split(" "), 1, 1)[0] for t in texts[:10]]
    sets = [shingled(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    assert 10 <= len(links) < 20
    counts, verified = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda *args: counts.append(args[1].count()) or verified(*args))
    root = grouped(spark, texts, run=1)
    assert counts[1:] == [] or counts[1] < len(texts)
    assert all(root[a] == root[b] for a, b in links)
    assert len(set(root.values())) == len(texts) - len(links)


def test_slots_bound_what_is_in_common():
    """No pair that is similar and has a key in common is kept back."""
    rng = np.random.default_rng(18)
    base = rng.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(330, 400)], rng.integers(0, 1 << 62, rng.integers(0, 40))))) for _ in range(60)]
    slots = np.array([np.bincount(x % similar.SLOTS, minlength=similar.SLOTS) for x in sets], np.int32)
    whole = np.zeros((60, 4), np.int64)
    ids = np.arange(60)
    found = {tuple(p) for p in similar.strangers(ids, ids, np.full(60, 2), whole, slots, 0.8).tolist()}
    held = {(a, b) for b in range(60) for a in range(b) if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8}
    assert 0 < len(held) < 60 * 59 // 2 and held <= found


def test_last_part_of_a_long_run_is_long(spark, monkeypatch):
    """Texts of a run that comes in parts meet all others of it, also from a short last part."""
    monkeypatch.setattr(similar, "CHUNK", 20)
    keys = [pa.RecordBatch.from_pydict({"key": [7] * 3, "id": list(range(i, i + 3))}) for i in range(0, 33, 3)]
    parts = list(similar.runs(iter(keys), ["key", "id"]))
    assert len(parts) > 1 and len(parts[-1][0]) <= similar.RUN
    prints = [[5, 5, 5, 5]] * 45
    texts = spark.createDataFrame([(i, bytearray([i]), p) for i, p in enumerate(prints)], "id bigint, sha binary, print array<bigint>")
    _, over = similar.candidates(texts.coalesce(1))
    n = over.distinct().groupBy("key").count().agg({"count": "min"}).first()[0]
    assert n == 45


def test_no_document_is_lost(spark):
    rng = random.Random(13)
    a, b = (" ".join(rng.choice(VOCABULARY) for _ in range(60)) for _ in range(2))
    names = "doc_id bigint, text string, id int, sha string, row int, _rows int, root int, _id int, n int"
    rest = (1, "s", 2, 3, 4, 5, 6)
    rows = [(1, a), (1, b), (2, a), (3, a.replace(" ", "\n")), (4, None), (5, ""), (6, " \t"), (None, a), (None, a), (7, b + " end"), (7, b + " end")]
    docs = spark.createDataFrame([(*r, *rest) for r in rows], names).repartition(3)
    kept = similar.one_of_each_group(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert found == sorted([(1, a), (1, b), (4, ""), (0, a), (0, a)])
    assert all(tuple(r)[2:] == rest for r in kept.collect())
    assert similar.one_of_each_group(docs.limit(0)).collect() == []


def test_long_texts_and_few_words(spark):
    rng = random.Random(14)
    long = " ".join(rng.choice(VOCABULARY) for _ in range(60_000))
    root = grouped(spark, [long, long + " and more", "one two", "One  two", "one three", "x " * 500, "x " * 700])
    assert root[0] == root[1] and root[2] == root[3] != root[4] and root[5] == root[6]


NAMES = [
    "docs", "left", "rounds", "blocks", "rest", "_u", "block", "_rows", "_gone", "kept", "_n", "_spans", "_items",
    "_key0", "_host0", "_verdict0", "_best", "_lines", "_carried", "row", "a.b",
]


@pytest.mark.parametrize("name", ["mix_plan", "without_repeats", "cut_spans", "judge", "judge without rules"])
def test_other_columns_come_back(spark, name):
    """Whatever their names, with their own values."""
    rng = random.Random(15)
    shared = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(30)) + " " + shared for _ in range(6)]
    rows = [(i, t, "s", len(t), f"http://a{i}.net/x", *(100 * i + k for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    kinds = "doc_id bigint, text string, source string, n_chars bigint, url string, " + ", ".join(f"`{n}` int" for n in NAMES)
    docs = spark.createDataFrame(rows, kinds)
    items = spark.createDataFrame([(1, shared)], "item_id bigint, text string")
    run = {
        "mix_plan": lambda: mixing.mix_plan(docs),
        "without_repeats": lambda: suffixdedup.without_repeats(docs),
        "cut_spans": lambda: decontaminate.cut_spans(docs, items, max_coverage=1.0),
        "judge": lambda: urlfilter.judge(docs, [("block", "net/")]),
        "judge without rules": lambda: urlfilter.judge(docs, []),
    }
    out = run[name]()
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: tuple(r)[5 : 5 + len(NAMES)] for r in out.collect()}
    assert got == {i: tuple(100 * i + k for k in range(len(NAMES))) for i in range(6)}
    if name.startswith("judge"):
        assert {r.verdict for r in out.collect()} == {"block" if name == "judge" else "allow"}


def test_texts_that_are_left(spark):
    """The texts of both cutting operators, byte for byte."""
    rng = random.Random(16)
    make = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    passage, item = make(40), make(20)
    texts = [make(20) + " " + passage + " " + make(9), "ö " + make(11) + " " + passage, make(7) + " " + item.upper() + ", " + make(30), item, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        data = text.encode()
        gone = [False] * len(data)
        windows = [data[a : a + 100] for a in range(len(data) - 99)]
        for a, w in enumerate(windows):
            if w in seen:
                gone[a : a + 100] = [True] * 100
            seen.add(w)
        expected[i] = bytes(c for c, g in zip(data, gone) if not g).decode()
    left = {r.doc_id: r.text for r in suffixdedup.without_repeats(docs).collect()}
    assert left == {i: t for i, t in expected.items() if t or not texts[i]} and left[1] != texts[1]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, items, max_coverage=0.9).collect()}
    at = texts[2].index(item.upper())
    assert cut == {0: texts[0], 1: texts[1], 2: texts[2][:at] + texts[2][at + len(item) :], 4: ""}


def test_written_shards_hold_each_copy(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, "ab"[i % 2], "w " * rng.randint(1, 60)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    plan = mixing.mix_plan(docs, total=1.2, block_words=300, shard_words=1000)
    told = {r.doc_id: sorted(r.shards) for r in plan.collect()}
    mixing.write_shards(plan, str(tmp_path / "shards"))
    written = {}
    for r in spark.read.parquet(str(tmp_path / "shards")).collect():
        written.setdefault(r.doc_id, []).append(r.shard)
    assert {d: sorted(s) for d, s in written.items()} == {d: s for d, s in told.items() if s}
