"""Exact dedup, conversation repair and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from watchglass.llm import catalogue, conversation_repair as repair, exact_dedup, merkle  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, first int, keeper int, __row int, at int"


def documents(spark, texts, ids=None, sources=None):
    """Documents with further columns of names that the operators use."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), "r", 1, 2, 3, 4) for i, t, s in zip(ids, texts, sources)], DOCS
    )


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Exact dedup


def plain_groups(texts, ids):
    """(doc_id, keep_id, size, kept, digest) of every row, as a multiset."""
    groups = defaultdict(list)
    for row, (i, t) in enumerate(zip(ids, texts)):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i, row))
    out = []
    for text, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        for k, (_, i, _) in enumerate(rows):
            out.append((i, rows[0][1], len(rows), k == 0, sha(text)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 40))) for _ in range(40)]
    long = " ".join(f"word{rng.randrange(9999)}" for _ in range(60_000))
    texts = [*base, *base[:10], base[0].replace(" ", "\n\t "), base[1] + " ", " " + base[1], None, "", " ", "\n\n", "\x00", "é\U0001f600"]
    texts += [long, long[:-1] + "~", "~" + long[1:], long.replace(" ", "  "), "hot line"] + ["hot  line"] * 300
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[2] = ids[5] = ids[41] = None
    ids[7] = ids[8] = ids[47] = 3
    return texts, ids


def found_groups(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()), key=str)


def test_exact_duplicates(spark, awkward):
    texts, ids = awkward
    docs = documents(spark, texts, ids).repartition(3)
    got = exact_dedup.duplicates(docs, members=16)
    assert got.columns == ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found_groups(got) == plain_groups(texts, ids)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(g[0]) for g in plain_groups(texts, ids) if g[3])


def test_colliding_fingerprints_are_told_apart(spark, awkward):
    """Of fingerprints modulo 1 only the lengths are left: texts are told apart by their bytes alone."""
    texts = awkward[0][:60] + ["ab", "ba", "cd", "ab", "dc", "cd", "ba"]
    ids = list(range(len(texts)))
    docs = documents(spark, texts, ids)
    assert found_groups(exact_dedup.duplicates(docs, primes=(1, 1), chunk=7)) == plain_groups(texts, ids)


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 150_000, dtype=np.uint8)
    for prime, base, got in zip(
        exact_dedup.PRIMES, exact_dedup.BASES,
        zip(*(exact_dedup.fingerprint(data[at : at + 40_000], at, exact_dedup.PRIMES) for at in range(0, len(data), 40_000))),
    ):
        want = 0
        for x in reversed(data.tolist()):
            want = (want * base + x) % prime
        assert sum(got) % prime == want


def test_exact_empty_table(spark):
    docs = documents(spark, [])
    assert exact_dedup.duplicates(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


# Conversation repair


def plain_best(codes):
    """The least (cost, audit) by the values of all suffixes."""
    best = {}
    for i in range(len(codes), -1, -1):
        value = {}
        for s in range(4):
            found = [(0, "")] if i == len(codes) and s in repair.ENDING else []
            if i < len(codes):
                for letter, cost, t in repair.MOVES[codes[i]][s]:
                    c, a = best[i + 1, t]
                    found.append((cost + c, letter + a))
            value[s] = found
        for _ in range(4):
            for s in range(4):
                after = value[repair.FOLLOWS[s]]
                if after:
                    c, a = min(after)
                    value[s].append((2 + c, "I" + a))
        for s in range(4):
            best[i, s] = min(value[s])
    return best[0, 0]


def enumerated_best(codes):
    """The least (cost, audit) among all sequences of edits with at most three inserted messages in a place."""
    found = []
    choices = []
    for code in codes:
        fault, initial = divmod(code, 4)
        own = [("D", 3, "")]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            more = int(fault == repair.TRUNCATED)
            own.append(("K", more, "sua?"[initial]))
            own += [("R", 2 + more, x) for x in "ua"]
        choices.append(own)
    gaps = ["", *("".join(p) for n in (1, 2, 3) for p in itertools.product("ua", repeat=n))]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(codes) + 1):
            roles = "".join(x + e[2] for x, e in zip(inserts, edits)) + inserts[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(x) + e[0] for x, e in zip(inserts, edits)) + "I" * len(inserts[-1])
                found.append((sum(e[1] for e in edits) + 2 * sum(map(len, inserts)), audit))
    return min(found)


def test_search_finds_the_least_repair(monkeypatch):
    rng = random.Random(2)
    for codes in [b"", *(bytes([c]) for c in range(16)), *(bytes(p) for p in itertools.product((0, 1, 2, 3, 5, 14), repeat=2))]:
        assert repair.search(codes) == enumerated_best(codes)
    for _ in range(400):
        codes = bytes(rng.choice((0, 1, 1, 1, 2, 2, 2, 3, 5, 9, 13, 14, 15)) for _ in range(rng.randint(1, 40)))
        want = plain_best(codes)
        assert repair.search(codes) == want
        for block in (1, 2, 7):
            monkeypatch.setattr(repair, "BLOCK", block)
            assert repair.search(codes) == want
        monkeypatch.undo()
    cost, audit = repair.search(bytes([1, 2] * 100_000))
    assert cost == 0 and audit == "K" * 200_000


def plain_repairs(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        kept = groups[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(f"{len(r[1])}:{r[1]}{r[2]}")))
        codes, seen = [], set()
        for turn, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(fault * 4 + ("sua".index(role[0]) if role[:1] and role[0] in "sua" else 3))
        cost, audit = plain_best(bytes(codes))
        lines, roles, rest = [], "", list(kept)
        for letter in audit:
            new = "a" if roles[-1:] == "u" else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[new])
                roles += new
                continue
            _, role, text = rest.pop(0)
            if letter == "K":
                lines.append(f"{role}:{text}")
                roles += role[0]
            elif letter == "R":
                lines.append({"u": "user:", "a": "assistant:"}[new] + text)
                roles += new
        assert re.fullmatch("(s?(ua)+)?", roles)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        faults = [sum(c // 4 == k for c in codes) for k in (1, 2, 3)]
        out[conv] = (gaps, *faults, illegal, cost, audit, sha("\n".join(lines)))
    return out


def found_repairs(frame):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in frame.collect()
    }


def test_repairs_of_awkward_conversations(spark):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "and so on", "", " \n", None, "Why?", "a. b", "é?　", "line\nline."]
    rows = [
        (rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
        for _ in range(500)
    ]
    rows += [(1000, 0, "user", "x.")] + [(1001, t, "user", "the same") for t in range(300)] + [(1002, 5, "user", "y.")] * 40
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, code string"
    ).repartition(3)
    assert found_repairs(repair.repair(repair.damaged(docs))[1]) == plain_repairs(rows)
    empty = docs.where("conv_id = -1")
    assert repair.repair(repair.damaged(empty))[1].count() == 0


def test_repairs_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_repairs(catalogue.op11_conversation_repair(spark, SF)) == plain_repairs(rows)


# Merkle manifest


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def plain_path(levels, at):
    """(left siblings, right siblings) by level."""
    for nodes in levels[:-1]:
        first = at - at % 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of rows (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[(r[1] is not None, (r[1] or "").encode())].append(((r[0] is not None, r[0] or 0, plain_leaf(r)), r))
    keys = sorted(trees)
    for k in keys:
        trees[k].sort(key=lambda x: x[0])
    inner = {k: plain_tree([x[0][2] for x in trees[k]]) for k in keys}
    crown = plain_tree([inner[k][-1][0] for k in keys])
    out = []
    for k, key in enumerate(keys):
        for at, ((_, _, leaf), r) in enumerate(trees[key]):
            path = [*plain_path(inner[key], at), *plain_path(crown, k)]
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in path))
            root = crown[-1][0]
            out.append((r[0], leaf, inner[key][-1][0], root, proof, now, now == root))
    return sorted(out, key=str)


def found_manifest(frame):
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect()), key=str
    )


def tampered(docs):
    from pyspark.sql import functions as F

    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, text_now=F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), span=1)


@pytest.mark.parametrize("n", [1, 2, 4, 120])
def test_manifest_of_awkward_rows(spark, n):
    rng = random.Random(n)
    texts = ["one\ntwo", None, "", "é\n漢", "plain", "x" * 20_000 + "\n"]
    sources = ["a", "a", "a", "b", "", None, "é", "Z", *(f"s{i}" for i in range(12))]
    rows = [
        (rng.choice([None, 3, 1 << 60, *range(80)]), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(texts))
        for _ in range(n)
    ]
    rows += rows[: n // 10]
    docs = spark.createDataFrame(
        [(*r, 1, "t") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string"
    ).repartition(3)
    assert found_manifest(tampered(docs)) == plain_manifest(rows)


def test_manifest_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = found_manifest(catalogue.op13_merkle_manifest(spark, SF))
    assert got == plain_manifest(rows)
    assert {True, False} == {r[-1] for r in got}


def test_manifest_of_an_empty_table(spark):
    docs = documents(spark, [])
    assert merkle.manifest(docs).count() == 0


def test_only_texts_that_are_compared_are_shuffled(spark):
    from pyspark.sql import functions as F

    texts = spark.range(0, 90_000, 1, 3).select(
        (F.col("id") % 30_000 + F.floor(F.col("id") / 30_000) * 2**33).alias("row"), F.col("id").cast("string").alias("text")
    )
    wanted = texts.where("text % 971 = 0 OR text IN (7, 8, 32767, 32768, 32769, 89999)").select("row")
    got = exact_dedup._only(texts, wanted.unionByName(wanted))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, texts.join(wanted, "row").select("row", "text").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
