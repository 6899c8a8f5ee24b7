"""Each operator against a brute-force version on a small corpus with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from evalspark.llm import chat, decontaminate, mixing, repeats, rules, similar, simhash, suffixdedup, tokencount, toxicity, urlfilter
from evalspark.llm.lyndon import suffix_array
from evalspark.llm.substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, start string, _u int"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, periodic, long, empty, null and odd texts."""
    rng = random.Random(5)
    words = ["the", "of", "é", "naïve", "Über", "cat", "dog", "a", "日本", "x1", "run", "Sun", "moon day", "#tag", "end."]
    make = lambda n: " ".join(rng.choice(words) + (rng.choice(["", "", "\n", "\t"])) for _ in range(n))
    passage, base = make(60), make(200)
    texts = [None, "", " \n", "one", "the of", base, base, base.replace("cat", "cow", 3), "ab " * 90, "z" * 400, "z" * 450]
    texts += [make(20) + " " + passage + " " + make(15) for _ in range(4)] + [make(rng.randint(1, 80)) for _ in range(20)]
    texts += [make(3000), texts[15], passage[: len(passage) // 2]]
    found = [(i, t, "en", rng.choice(["a", "b", "Z", None]), len(t) if t else None, "k", "s", 1) for i, t in enumerate(texts)]
    return [*found, (None, base, "en", "a", len(base), "k", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame) -> dict:
    got = {}
    for r in frame.collect():
        assert r.doc_id not in got
        got[r.doc_id] = tuple(r)[1:]
    return got


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def covered(windows: int, width: int, n: int, seen: set, window) -> list[bool]:
    gone = [False] * n
    for a in range(windows):
        w = window(a)
        if w in seen:
            gone[a : a + width] = [True] * width
        seen.add(w)
    return gone


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_KEY", hot)
    seen, expected = set(), {}
    for doc, text, *_ in in_order(rows):
        w = (text or "").encode().split()
        gone = covered(len(w) - 19, 20, len(w), seen, lambda a: tuple(w[a : a + 20]))
        expected[doc] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    got = by_id(substring_dedup(docs, shard_words=500))
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == expected
    assert sum(x[1] for x in expected.values()) > 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_KEY", hot)
    seen, expected = set(), {}
    for doc, text, *_ in in_order(rows):
        w = (text or "").encode()
        gone = covered(len(w) - 99, 100, len(w), seen, lambda a: w[a : a + 100])
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        expected[doc] = (len(w), sum(gone), spans, sha(bytes(x for x, g in zip(w, gone) if not g)))
    assert by_id(suffixdedup.suffix_dedup(docs, shard_bytes=3000)) == expected


def test_suffix_dedup_text(spark, docs, rows):
    left = {r.doc_id: r for r in suffixdedup.without_repeats(docs).collect()}
    told = by_id(suffixdedup.suffix_dedup(docs))
    assert set(left) == {k for k, v in told.items() if v[0] == 0 or v[1] < v[0]}
    for doc, text, *_ in rows:
        if doc in left and told[doc][1] == 0:
            assert left[doc].text == text
        elif doc in left:
            assert left[doc].n_chars == len(left[doc].text) < len(text)
    # A cut inside a character leaves valid text.
    texts = [("é" * 80 + "a"), ("x" + "é" * 80)]
    cut = suffixdedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width=99)
    assert all(set(r.text) <= {"x", "é", "a"} for r in cut.collect())


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_phrases_and_bytes_agree():
    rng = random.Random(2)
    base = [bytes(rng.choice(b"ab \n") for _ in range(160)) for _ in range(6)]
    segments = [x[rng.randint(0, 20) : 140] for x in base for _ in range(4)]
    sizes, order = np.array([len(x) - 99 for x in segments]), np.arange(len(segments)) << 32
    one, two = (f(segments, sizes, order, 100) for f in (suffixdedup.by_bytes, suffixdedup.by_phrases))
    assert all((a == b).all() for a, b in zip(one, two)) and any(a.any() for a in one)


@pytest.mark.parametrize("block_words", [200_000, 15])
def test_decontamination(spark, docs, rows, block_words):
    items = [(1, rows[5][1][40:200]), (2, "The of"), (3, ""), (4, None), (5, "the OF"), (6, rows[12][1]), (10, "zebra")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: word.findall(lower(t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = of(text)
        for x in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[i : i + 10]) for i in range(len(w) - 9)]:
            windows[x].add(str(item))
    expected = {}
    for doc, text, *_ in rows:
        w = of(text)
        hit, met = [False] * len(w), set()
        for i in range(len(w)):
            for k in {len(x) for x in windows}:
                if i + k <= len(w) and tuple(w[i : i + k]) in windows:
                    hit[i : i + k] = [True] * k
                    met |= windows[tuple(w[i : i + k])]
        expected[doc] = (len(w), sum(hit), len(met), sha(",".join(sorted(met))), any(hit))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert by_id(decontaminate.report(docs, table, block_words=block_words)) == expected
    cut = decontaminate.cut_spans(docs, table, max_coverage=1.0)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    clean = {r[0]: r[1] for r in rows if not expected[r[0]][4]}
    assert {r.doc_id: r.text for r in cut.collect() if r.doc_id in clean} == clean
    gone = decontaminate.cut_spans(docs, table, max_coverage=0.0)
    assert {r.doc_id for r in gone.collect()} == set(clean)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(docs, rows, bucket):
    fps = {}
    for doc, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in parts]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda d: (d is None, d or 0)
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)), key=order)
                parent[y] = x
    assert by_id(simhash.near_groups(docs, bucket)) == {d: (f"{fps[d]:016x}", root(d)) for d in fps}


def test_chat(spark):
    rng = random.Random(3)
    bits = ["<", "|", "\\", "im_end|>", "<|im_end|>", "<|im_start|>", "\n", "n|", "é", "assistant", "$1", "<n|", "<\\|", ""]
    roles = ["assistant", "user", "a\nb", "<n|", "<\\n|x", "<|im_start|>", None, ""]
    turns = [(c, t, rng.choice(roles), rng.choice([None, "".join(rng.choice(bits) for _ in range(6))])) for c in range(150) for t in range(3)]
    turns += [(None, 0, "user", "x"), (0, 0, *turns[0][2:])]
    wanted = collections.defaultdict(list)
    for c, t, role, text in turns:
        wanted[c].append((t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == set(wanted)
    for c, own in wanted.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert tuple(got[c])[1:5] == (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss))
        assert got[c].identical


def test_url_filter(spark):
    listed = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    rng = random.Random(2)
    bits = ["http://", "x", ".net", "example", ".com", ".org", "/", "/en/", "/de/", "/fr/", "?", "#", "a.", "EXAMPLE", ".NET", ":", "É"]
    urls = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), "h") for i in range(600)] + [(None, None, "h")] * 2
    urls += [(1000 + i, f"https://{h}{p}", "h") for i, (h, p) in enumerate((h, p) for h in ("a.example.net", "b.org", "net", "xnet") for p in ("", "/", "/en/1", "/fr/?q"))]

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        host = lower(host)
        fits = [(len(k), k, v) for v, k in listed for h, p in [k.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    got = urlfilter.judge(spark.createDataFrame(urls, "page_id bigint, url string, rule string"), listed)
    assert sorted(map(str, (tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()))) == sorted(str((i, *judge(u))) for i, u, _ in urls)


def test_rules(docs, rows):
    for r in rules.report(docs).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = [False] * len(w)
        for i in range(len(w) - 4):
            if windows[tuple(w[i : i + 5])] > 1:
                hit[i : i + 5] = [True] * 5
        lines = [x for x in text.split("\n") if WORD.search(x)]
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit))
        assert tuple(r)[1:6] == wanted, r.doc_id
        assert r.base_failed == (len(w) < 10 or 100 * sum(hit) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_mixing(spark, docs, rows):
    plan = mixing.mix_plan(docs, block_words=300, shard_words=2000).drop("text").collect()
    again = mixing.mix_plan(docs, block_words=300, shard_words=2000).drop("text").collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and len(plan) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    own = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, target, free = 1.5 * sum(own.values()), {}, set(sources)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * own[s]}
        target |= {s: 2 * own[s] for s in full} if full else {s: share * weight[s] for s in free}
        left -= sum(2 * own[s] for s in full)
        free = free - full if full else set()
    for r in plan:
        assert r.size == size(next(x[1] for x in rows if x[0] == r.doc_id)) and r.source_size == own[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        assert len(r.shards) * r.size == r.taken
    for s in sources:
        taken = sum(r.taken for r in plan if r.source == s)
        # Within the smallest document that was not taken.
        assert taken <= target[s] + 1 and target[s] - taken < max(300, 0.3 * target[s])


def test_quota_tree(spark):
    units = spark.createDataFrame([(1, 13), (2, 0), (3, 50)], "_r int, units bigint")
    got = mixing.split_quotas(units, 3, "s", spark).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in got:
        by_source[r["_r"]] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {1: 13, 3: 50, 2: 0} and set(by_shard.values()) <= {7, 8} and len(by_shard) == 8


def test_token_counts(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = tokencount.zipf_pieces()
    vocabulary = [("<unk>", -1000.0), *((f"<0x{i:02X}>", -1000.0) for i in range(256)), *pieces.items()]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, byte_fallback=True))
    count = lambda t: sum(len(model.encode("▁" + w).tokens) for w in WORD.findall(t or ""))
    got = by_id(tokencount.token_counts(docs))
    assert got == {r[0]: (len(WORD.findall(r[1] or "")), count(r[1])) for r in rows}


def test_toxicity(spark, none):
    rng = random.Random(4)
    words = ["tree", "house", "river", "stone", "cloud", "apple", "trade", "train"]
    texts, marks = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["trash", "tr4sh", "TRASH", "trаsh"])
        texts.append((i, " ".join(w)))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*texts, (None, None), (900, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = by_id(toxicity.report(docs, labels))
    assert len(got) == 402 and all(0 <= s <= 1 for _, s, _ in got.values())
    assert all(got[i][2] == m for i, m in marks) and got[None][2] == got[900][2] == 0
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, m in marks if not m} | {None, 900}
    assert {p for _, _, p in by_id(toxicity.report(docs, labels.limit(0))).values()} == {0}


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert decontaminate.report(none, items).count() == 0
    assert substring_dedup(none).count() == suffixdedup.suffix_dedup(none).count() == 0
    assert suffixdedup.without_repeats(none).count() == simhash.near_groups(none).count() == 0
    assert similar.one_of_each_group(none).count() == mixing.mix_plan(none).count() == 0
    assert rules.report(none).count() == tokencount.token_counts(none).count() == 0
    assert toxicity.report(none, labels).count() == toxicity.without_toxic(none, labels).count() == 0
    assert chat.report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string"), [("block", "net/")]).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    twice = spark.createDataFrame([(1, text, "a")] * 2 + [(2, text, "a")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(twice).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert sorted(r.doc_id for r in similar.one_of_each_group(twice).collect()) == [1]
    assert suffixdedup.without_repeats(twice).count() == 2
    assert mixing.mix_plan(twice).count() == 3
