"""Operators 11 to 13 against brute force and their SQL: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from voltaflow.llm import merkle, near_dedup, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, grp string, word string, n long, idx long"


def frame(spark, rows):
    """rows (doc_id, text, lang, source, n_chars) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "x", "x", 7, 7) for r in rows], SCHEMA)


def rows_of(n=60, seed=3):
    rng = random.Random(seed)
    words = ["wort%d" % i for i in range(50)] + ["Straße", "écrit", "écrite", "Écrit", "colour", "color", "colour", "Colour"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = [(i, text(rng.randint(0, 80)), rng.choice(["en", "de", "fr", "es", None, "é", ""]), rng.choice(["a", None]), rng.choice([i, None])) for i in range(n)]
    out += [(n, None, "en", "a", 4), (n + 1, "", None, None, None), (n + 2, " \n", "en", "a", 2**63 - 1), (None, "no id", "en", "a", 1), (None, None, None, None, None)]
    out += [out[3], out[3], (3, "another text of the same id", out[3][2], "a", 9), (n + 3, text(20000), "lone", "a", 1)]
    near = text(200).split()
    for i in range(40):
        changed = list(near)
        for _ in range(i % 6):
            changed[rng.randrange(200)] = rng.choice(words)
        out.append((n + 10 + i, " ".join(changed), "en", "s", 5))
    return out


# ---- 11


def shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    return [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []


def plain_fingerprint(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, radius):
    """items: (id, fp); the least id (None where there is none) of each item's component."""
    fps = sorted({f for _, f in items})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, f in items:
        if k is not None:
            least[top(f)].append(k)
    return [(k, f, min(least[top(f)], default=None)) for k, f in items]


def test_fingerprints_are_the_contract(spark):
    rows = rows_of()
    for text in [r[1] for r in rows] + ["one", "one two three", "A b C d É", "a b c d", "x " * 70000]:
        assert near_dedup.fingerprint(text) == plain_fingerprint(text)
    assert near_dedup.fingerprint("A B C D") == near_dedup.fingerprint("a b c d") != near_dedup.fingerprint("a É c d") != near_dedup.fingerprint("a é c d")


@pytest.mark.parametrize("n", [0, 60])
def test_near_dedup(spark, n, tmp_path):
    rows = rows_of(n) if n else []
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = near_dedup.op11_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows], near_dedup.RADIUS)
    assert sorted(map(repr, ((r[0], int(r[1], 16), r[2]) for r in got.collect()))) == sorted(map(repr, want))


def test_dense_groups_and_chains_meet_in_blocks(spark, monkeypatch):
    """Fingerprints around centres, chains of many steps and random ones, with blocks of five rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(11)
    fps = {0, 2**64 - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(40):  # a chain: neighbours differ in four bits
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(at)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = {int(np.uint64(f).astype(np.int64)): f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = defaultdict(set)
    for r in near_dedup.linked(spark, near_dedup.Scratch(spark), df).collect():
        got[r.comp].add(signed[r.node])
    want = defaultdict(set)
    for _, f, least in plain_components([(f, f) for f in fps], near_dedup.RADIUS):
        want[least].add(f)
    assert {frozenset(c) for c in got.values()} == {frozenset(c) for c in want.values() if len(c) > 1}


def test_block_tables_hold_every_close_pair():
    masks = near_dedup.block_masks()
    rng = random.Random(2)
    assert len(masks) == 15
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & (m % (1 << 64)) == 0 for m in masks)


# ---- 12


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + extra
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((i % 2, "".join(x for j, x in enumerate(run) if j != i % 2)))
        i //= 2
    return out


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["-" if r[2] is None else "=" + r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: g.encode())
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    tops = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (has_id, doc_id, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], i) + plain_path(tops, at)
            h = plain_leaf(row, 1) if has_id and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for side, others in path:
                h = sha(others + h if side else h + others)
            root = tops[-1][0]
            out.append((row[0], own, trees[g][-1][0], root, sha("".join(o for _, o in path)), h, h == root))
    return out


@pytest.mark.parametrize("span", [1, 3, 10])
def test_manifest(spark, span, monkeypatch, tmp_path):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (span,))
    rows = rows_of()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op12_query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("k", [0, 1, 2])
def test_small_manifests(spark, tmp_path, k):
    rows = [(5, "a", "en", "s", 1), (7, None, None, None, None)][:k]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, merkle.op12_query(spark, str(tmp_path)).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)


# ---- 13


def plain_words(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                found[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def variant_rows():
    rng = random.Random(8)
    base = ["colour", "straße", "élève", "aaaaa", "abcdef", "banana", "ÀÉÎÕÜ", "wwwww", "x÷y×z"]
    out = []
    for b in base:
        forms = {b}
        for _ in range(25):
            w, i = rng.choice(sorted(forms)), rng.randrange(5)
            c = rng.choice("abcéÿz÷")
            forms.add(rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]]))
        for f in sorted(forms):
            k = rng.choice([3, 3, 4, 6, 8, 12, 16, 24, 48])
            out += [f if rng.random() < 0.9 else f.upper() if f.isascii() else f for _ in range(k)]
    rng.shuffle(out)
    rows = [(i, " ".join(out[i * 7 : i * 7 + 7]), None, None, None) for i in range(len(out) // 7 + 1)]
    return rows + [(None, "colour colour-colour straße", None, None, None), (5, None, None, None, None), (6, "", None, None, None), rows[3], rows[3], (99999, "elegant " * 30000, None, None, None)]


def test_variants(spark, tmp_path):
    rows = variant_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_query(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) != len(r[1]) for r in want if r[1])


def test_no_words(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op13_query(spark, str(tmp_path)).collect() == []


# ---- SQL


@pytest.mark.parametrize(("query", "sql"), [(merkle.op12_query, merkle.OP12_SQL), (spelling.op13_query, spelling.OP13_SQL)])
def test_queries_equal_sql(spark, tmp_path, query, sql):
    rows = [r for r in rows_of() if r[4] != 2**63 - 1] + variant_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        got = query(spark, folder)
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if 'sf' in folder else '/*.parquet'}'")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(sql).select(*got.columns).fetchall(), key=repr)
