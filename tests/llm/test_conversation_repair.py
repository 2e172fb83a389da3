import hashlib
import random
import re
import zlib
from itertools import pairwise

import pytest

from sedimark.llm import conversation_repair
from sedimark.llm.conversation_repair import END, auction, damage, prices, repair, trace

SHAPE = re.compile("(s?(ua)+)?")
PARTS = re.compile("(s?(ua)*u?)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All edits of least cost by growing sequences; rows: (role, text, fault). Gives cost, audit, repaired."""
    best = {"": (0, "", ())}  # initials so far: cost, audit, lines

    def better(into, initials, row):
        if PARTS.fullmatch(initials):
            # what may follow depends on the last initials alone
            key = initials if len(initials) < 3 else initials[-2:] + "+"
            if key not in into or row < into[key]:
                into[key] = row

    def inserted(best):
        for _ in range(2):
            more = dict(best)
            for initials, (cost, audit, lines) in best.items():
                for role in ("user", "assistant"):
                    better(more, grown(initials, role[0]), (cost + 3, audit + "I", (*lines, role + ":")))
            best = more
        return best

    def grown(initials, c):
        return initials.replace("ua+", "ua").replace("au+", "uau") + c if initials.endswith("+") else initials + c

    for role, text, fault in rows:
        new = {}
        for initials, (cost, audit, lines) in inserted(best).items():
            better(new, initials.replace("ua+", "ua").replace("au+", "uau"), (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                better(new, grown(initials, role[:1]), (more, audit + "K", (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    better(new, grown(initials, other[0]), (more + 3, audit + "R", (*lines, f"{other}:{text}")))
        best = new
    return min(v for k, v in inserted(best).items() if SHAPE.fullmatch(k.replace("ua+", "ua").replace("au+", "uau")))


def brute(original):
    out = set()
    after = damaged(original)
    for conv in {r[0] for r in original}:
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        rows = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        seen, faults = set(), []
        for _, _, role, text in rows:
            body = re.sub("[\x20\x09-\x0d]+$", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(rows, faults, strict=True)])
        out.add((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def table(seed, convs=40):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", "a. b", "end. \n", "é.", "x" * 50 + "."]
    rows = []
    for c in range(convs):
        n = r.choice([1, 2, 3, 5, 8, 13]) if c else 150
        for t in range(n):
            role = r.choice(["user", "assistant", "system", "tool"]) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c - 3, t + (t > 4) * 2, role, r.choice(texts)))
    return rows + [(None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (900, None, "user", "a."), (900, None, "user", "a."), (900, 3, "", "b."), (901, 0, "", ""), (902, 5, "User", "c.")]


KIND = "conv_id bigint, turn bigint, role string, text string, cost string, part string"


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_matches_brute_force(spark, partitions):
    rows = table(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = repair(damage(spark.createDataFrame([(*r, "x", "y") for r in rows], KIND).repartition(3)), gone="gone")
        assert got.columns[0] == "conv_id"
        found = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_damage(spark):
    rows = table(7)
    got = damage(spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)).where("not gone").drop("gone")
    show = lambda rows: sorted(map(str, rows))
    assert show(tuple(r) for r in got.collect()) == show(damaged(rows))


def test_empty_and_gone(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair(empty).collect() == [] and repair(damage(empty), gone="gone").collect() == []
    one = repair(spark.createDataFrame([(4, 0, "user", "a.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean"), gone="gone").collect()
    assert [tuple(r) for r in one] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_text_of_ten_megabytes(spark):
    rows = [(1, 0, "user", "x " * 5_000_000 + "."), (1, 1, "assistant", "y.")]
    got = repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert (got.cost, got.audit, got.repaired_sha256) == (0, "KK", hashlib.sha256(f"user:{rows[0][3]}\nassistant:y.".encode()).hexdigest())


def test_prices_are_exact_and_tight_arcs_lead_to_the_end():
    r = random.Random(3)
    for _ in range(60):
        codes = bytes(r.randrange(15) for _ in range(r.choice([0, 1, 5, 40]))) + bytes([END])
        exact = [0] * 4
        dist = []
        for code in reversed(codes):
            layer = [10**9] * 4
            for _ in range(4):
                for s in range(4):
                    layer[s] = min(c + (layer[to] if to < 4 else exact[to - 4]) for _, c, to in conversation_repair.ARCS[code][s])
            exact = layer
            dist.append(layer)
        price = [*prices(codes, [0] * 4), *[0] * 4]
        assert price[:4] == dist[-1]
        assert all(p <= d for p, d in zip(price, [x for layer in reversed(dist) for x in layer], strict=False))  # dual feasible
        letters, _ = trace(codes, price, 0)
        assert sum({"D": 4, "I": 3, "R": 3, "K": 0}[x] for x in letters) <= price[0]
    assert auction(bytes([END]), [0] * 4)[:4] == [0, 6, 3, 0]
