"""SentencePiece coding, spelling variants and conversation repair against brute force."""

import collections
import hashlib
import random
import re
from zlib import crc32

import duckdb
import pytest
import sentencepiece as library

from evalspark.llm import queries, sentencepiece, turns, variants
from evalspark.llm.oracles import SQL

CLASHING = ["ids_", "word", "n", "key", "at", "fault", "again", "rows", "_u"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# SentencePiece


@pytest.fixture(scope="module")
def processor():
    return library.SentencePieceProcessor(model_file=sentencepiece.PATH)


@pytest.fixture(scope="module")
def coder():
    return sentencepiece.Encoder(sentencepiece.read_model())


def odd_texts(count: int) -> list[str]:
    rng = random.Random(3)
    parts = ["the", "er", "in", " ", "  ", "▁", "\n", "\t\r\n", "日本", "😀", "é", "\x00", "zz", "<s>", "<0x0A>", "1", "aaaa", " x"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(count)]
    made += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(97, 110), 32])) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    return ["", " ", "a" * 3000, " " * 100, "x" * 70 + " " + "é" * 200, *made]


def test_ids_and_texts_equal_the_library(coder, processor):
    for text in odd_texts(1500):
        ids = processor.encode(text)
        assert list(memoryview(coder.encode(text)).cast("i")) == ids, text
        assert coder.decode(ids) == processor.decode(ids), text


def test_any_ids_decode_as_in_the_library(coder, processor):
    rng = random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 259]) for _ in range(rng.randint(0, 6))]
        assert coder.decode(ids) == processor.decode(ids), ids


def test_search_needs_no_cuts_and_goes_back(coder, processor):
    """Whole texts without the cut before word signs, and a vocabulary where the longest match is wrong."""
    text = "▁" + "the theatre of internationalisation".replace(" ", "▁")
    assert [coder.ids[p] for p in coder.search(text)] == processor.encode(text[1:])
    small = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    small += [(p, -float(i), 1) for i, p in enumerate(["bc", "ab", "abc", "cd", "bcd", *"▁abcd"])]
    other = sentencepiece.Encoder(small)
    for length in range(1, 7):
        for k in range(4**length):
            text = "".join("abcd"[k // 4**i % 4] for i in range(length))
            assert other.search(text) == other.merges.merged(text)


def test_rows_are_carried(spark, processor):
    kinds = "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in CLASHING)
    rows = [(i, t, *range(len(CLASHING))) for i, t in enumerate(odd_texts(20))] + [(None, None, *range(len(CLASHING)))] * 2
    docs = spark.createDataFrame(rows, kinds)
    got = sentencepiece.decode(sentencepiece.encode(docs)).collect()
    expected = sorted((str(t or ""), processor.encode(t or ""), tuple(rest)) for _, t, *rest in rows)
    assert sorted((r.text or "", r.ids, tuple(r[2:-2])) for r in got) == expected
    assert all(r.decoded == processor.decode(r.ids) for r in got)
    with pytest.raises(ValueError, match="ids"):
        sentencepiece.encode(docs.withColumn("IDS", docs["n"]))
    assert sentencepiece.decode(sentencepiece.encode(docs.limit(0))).collect() == []


# Spelling variants


def plain_groups(counts: dict[str, int]) -> dict[str, tuple]:
    words = {w: n for w, n in counts.items() if n >= 5}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    met = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(met[w]), words[form[w]] if form[w] else None)
    return out


def test_variant_groups(spark):
    rng = random.Random(1)
    counts = {}
    for _ in range(500):
        word = "".join(rng.choice("aabéÿ") for _ in range(rng.randint(6, 8)))
        counts[word] = rng.choice([1, 4, 5, 5, 6, 25, 30, 125, 700, 3600])
    counts |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "baaaaaaa": 125}
    table = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n bigint").repartition(3)
    got = {r.word: tuple(r)[1:] for r in variants.variant_groups(table).collect()}
    assert got == plain_groups(counts)
    assert variants.variant_groups(table.limit(0)).collect() == []


def test_word_counts(spark):
    texts = [None, "", "Straße straße STRASSE straßE", "Éclairs éclairs eclairs ÷×÷×÷× short1longer", "naïveté " * 5, "a-b " + "Wörter" * 300]
    rng = random.Random(2)
    texts += [" ".join(rng.choice(["Garden", "gardens", "öffnen", "thing", "Überall"]) for _ in range(50)) for _ in range(300)]
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word int, n int").repartition(4)
    expected = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mark % 7 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    assert {r.word: r.n for r in variants.word_counts(docs, slip=7).collect()} == expected


# Conversation repair


def plain_repair(rows: list[tuple]) -> tuple:
    """Cheapest edits of ``(turn, role, text)`` rows, edit strings carried whole."""
    seen, faulty = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append(fault)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def spread(ways):
        for _ in range(3):
            for state, (cost, edits, said) in list(ways.items()):
                new = follow[state]
                way = (cost + 2, edits + "I", said + ((full[new], ""),))
                if new not in ways or way[:2] < ways[new][:2]:
                    ways[new] = way
        return ways

    ways = spread({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faulty):
        found = {}
        for state, (cost, edits, said) in ways.items():
            extra, new = int(fault == "truncated"), follow[state]
            options = [(state, cost + 3, "D", said)]
            if fault not in ("blank", "duplicate"):
                options.append((new, cost + 2 + extra, "R", (*said, (full[new], text))))
                if role[:1] == new or (role[:1] == "s" and state == ""):
                    options.append((role[:1], cost + extra, "K", (*said, (role, text))))
            for to, price, edit, then in options:
                way = (price, edits + edit, then)
                if to not in found or way[:2] < found[to][:2]:
                    found[to] = way
        ways = spread(found)
    cost, audit, said = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = (faulty.count("blank"), faulty.count("duplicate"), faulty.count("truncated"))
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in said)))


KINDS = "conv_id bigint, turn bigint, role string, text string, fault int, again int, `kind` string"


def conversations(count: int, most: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Fine. \t", "日本。", None, "more", "Well.", "a?", "b?", "c.", "d."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "superuser", "", None]
    rows = []
    for conv in range(count):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 2, 9])
            rows.append((conv, turn if rng.random() > 0.05 else None, rng.choice(roles), rng.choice(texts), 7, 7, "k"))
    return rows


def grouped(rows: list[tuple]) -> dict:
    groups = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: sorted(found, key=order) for conv, found in groups.items()}


def test_repair_against_whole_strings(spark):
    rows = conversations(300, 12, 5) + [(None, 1, "user", "One?", 1, 1, "k"), (None, 2, "user", "Two?", 1, 1, "k")]
    table = spark.createDataFrame(rows, KINDS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(table).collect()}
    assert got == {conv: plain_repair(found) for conv, found in grouped(rows).items()}
    assert turns.report(table.limit(0)).collect() == []


def test_long_conversations_settle_and_spill(monkeypatch):
    """Rows leave early where ways meet; where they do not, older blocks go to the spill file."""
    monkeypatch.setattr(turns, "BLOCK", 4)
    monkeypatch.setattr(turns, "BLOCKS", 2)
    rng = random.Random(8)
    marks = {"": turns.FINE, "blank": turns.BLANK, "duplicate": turns.DUPLICATE, "truncated": turns.TRUNCATED}
    spilled = early = 0
    for case in range(200):
        roles = rng.choice([["tool"], ["user", "assistant"], ["system", "user", "assistant", "tool"], ["user"]])
        size = rng.randint(1, 300)
        rows = [(i, roles[i % len(roles)] if rng.random() > 0.2 else rng.choice(roles), f"{i}." if rng.random() > 0.1 else f"{i}") for i in range(size)]
        if case % 5 == 0:
            rows = [(0, "system", "Be kind.")] + [(i, "user", "") for i in range(size)]
        now, out = turns.Repair(turns.Steps()), []
        for turn, role, text in rows:
            fault = turns.BLANK if not text else turns.FINE if text.endswith(".") else turns.TRUNCATED
            out += now.add((turn, role, text, fault), role[0] if role[0] in "sua" else "", fault)
            early += bool(out)
            spilled += now.waiting.spilled > 0
        out += now.end()
        _, blank, duplicate, truncated, _, cost, audit, digest = plain_repair(rows)
        assert "".join(edit for _, edit, _ in out) == audit
        assert [row for row, _, _ in out if row] == [(*r, marks["blank" if not r[2] else "" if r[2][-1] == "." else "truncated"]) for r in rows]
        assert sha("\n".join(f"{role}:{row[2] if row else ''}" for row, edit, role in out if edit != "D")) == digest
    assert spilled and early


def test_repaired_conversations(spark):
    rows = [
        (1, 1, "user", "Hi.", 0, 0, ""), (1, 1, "user", "Hi.", 0, 0, ""), (1, 2, "user", "There?", 0, 0, ""),
        (2, 5, "system", "", 0, 0, ""),
    ]
    got = [tuple(r) for r in turns.repair(spark.createDataFrame(rows, KINDS)).orderBy("conv_id").collect()]
    first = [r for r in got if r[0] == 1]
    assert [r[1] for r in first] in (["K", "D", "R"], ["K", "R", "D"])
    assert [(r[5], r[6]) for r in first if r[1] != "D"] == [("user", "Hi."), ("assistant", "There?")]
    assert got[-1] == (2, "D", turns.BLANK, 5, "system", None, None)


def test_damage_keeps_every_conversation(spark):
    rows = conversations(200, 2, 6)
    table = spark.createDataFrame(rows, KINDS)
    got = {r.conv_id: tuple(r)[1:] for r in turns.report_all(table, turns.damaged(table)).collect()}
    hurt = []
    for conv, turn, role, text, *_ in rows:
        kind = crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    expected = {r[0]: (0, 0, 0, 0, 0, 0, "", sha("")) for r in rows}
    expected |= {conv: plain_repair(found) for conv, found in grouped(hurt).items()}
    assert got == expected


# SQL twins


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_conversation_repair"])
def test_twin(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, found.fetchall()))
