import hashlib
import itertools
import random
import re
import zlib
from functools import reduce

from skein.llm import turn_repair as tr


def cheapest(codes):
    """All audits with up to two insertions at each place, the least one whose roles fit."""
    best = None
    for edits in itertools.product("DKR", repeat=len(codes)):
        for holes in itertools.product(("", "I", "II"), repeat=len(codes) + 1):
            audit, cost, out, fits = "", 0, "", True
            for k, hole in enumerate(holes):
                for letter in hole + (edits[k] if k < len(codes) else ""):
                    audit += letter
                    due = "a" if out.endswith("u") else "u"
                    code = codes[k] if k < len(codes) else ""
                    if letter == "D":
                        cost += 4
                        continue
                    if letter == "I":
                        cost, out = cost + 3, out + due
                        continue
                    fits &= code != "d"
                    cost += 3 * code.isupper() + 3 * (letter == "R")
                    out += due if letter == "R" else code.lower()
            if fits and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def scan(codes):
    m = reduce(tr.product, [tr.CLOSURE, *(tr.EDITS[c] for c in codes)])
    cost, audit = min(m[tr.START][j] for j in (tr.START, tr.ASSISTANT) if m[tr.START][j])
    return cost, audit.replace("J", "K")


def test_scan_against_all_audits():
    rng = random.Random(2)
    cases = ["", *"dsuaxSUAX"] + ["".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(2, 4))) for _ in range(60)]
    for codes in cases:
        assert scan(codes) == cheapest(codes), codes


def test_associative():
    rng = random.Random(4)
    for _ in range(100):
        a, b, c = (tr.matrix("".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(1, 6)))) for _ in range(3))
        assert tr.product(tr.product(a, b), c) == tr.product(a, tr.product(b, c))


def plain(rows):
    """One conversation's result by a forward scan; rows are (turn, role, text) in order."""
    seen, codes, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        kept = text.rstrip(" \t\n\x0b\x0c\r")
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
        seen.add((role, text))
        codes += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        if fault:
            count[fault] += 1
    cost, audit = scan(codes)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    out, left = [], iter(rows)
    for edit in audit:
        due = "assistant" if out and out[-1][0].startswith("u") else "user"
        if edit == "I":
            out.append((due, ""))
        else:
            _, role, text = next(left)
            if edit != "D":
                out.append((due if edit == "R" else role, text))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *count.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost if rows else 0, audit, digest)


def plain_table(rows):
    out, held = {}, {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        held[conv] += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out[conv] = plain(turns)
    return out


def sample(rng, n):
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system", "tool", ""]), rng.choice([None, "", " \n", "Yes.", "No", "Why? ", "é!\x0b"])) for _ in range(n)]


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(6)
    rows = sample(rng, 900)
    # Long conversations, cut by partitions and pieces.
    rows += [(100, t, rng.choice(["user", "assistant", "system"]), f"Text {rng.randrange(2500)}{rng.choice(['.', ''])}") for t in range(3000)]
    rows += [(101, None, "user", "same.")] * 700 + [(102, t, "user" if t % 2 == 0 else "assistant", "word " * 20_000 + f"{t}.") for t in range(6)]
    df = spark.createDataFrame([(*r, "extra", "x") for r in rows], "conv_id long, turn long, role string, text string, at string, piece string")
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = tr.op12_turn_repair(spark, str(tmp_path)).collect()
    want = plain_table(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_tree_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(tr, "FAN", 2)
    rng = random.Random(9)
    rows = [(k % 2, t, rng.choice(["user", "assistant"]), f"Text {t}.") for k in range(2) for t in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    report, repaired = tr.repair(df)
    got = {r.conv_id: r for r in report.collect()}
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in (0, 1)}
    for conv, row in got.items():
        assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == want[conv][:7]
    out = [(r.role, r.text, r.edit) for r in repaired.filter("conv_id = 0").orderBy("at", "sub").collect()]
    assert "".join(e for _, _, e in out) == want[0][6].replace("D", "")
    assert [r for r, _, _ in out] == ["user", "assistant"] * (len(out) // 2)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert tr.op12_turn_repair(spark, str(tmp_path)).count() == 0
