import hashlib
import itertools
import random
import zlib


from kestrel.llm import queries, turn_repair as R
from scripts.oracle_check import TABLES, digest

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def costs(symbols):
    """Least (cost, audit) by trying every sequence of edits, with at most two inserts at a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(symbols)):
        for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            cost, said, at = 0, [], 0
            for e in audit:
                if e == "I":
                    cost, said = cost + 3, said + ["*"]
                    continue
                initial, fault = symbols[at]
                at += 1
                if e == "D":
                    cost += 4
                elif fault in ("blank", "duplicate"):
                    break
                else:
                    cost += (3 if e == "R" else 0) + (3 if fault == "truncated" else 0)
                    said.append("*" if e == "R" else initial)
            else:
                body = said[1:] if said[:1] == ["s"] else said
                if (said == [] or body) and len(body) % 2 == 0 and all(x in ("*", "ua"[k % 2]) for k, x in enumerate(body)):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def by_states(symbols):
    """The same, by a plain pass over the four states with whole audits."""
    ways = {0: (0, "")}
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(ways):
        out = dict(ways)
        for p, (c, a) in ways.items():
            for more in (1, 2):
                p = step[p]
                out[p] = min(out.get(p, (1 << 60, "")), (c + 3 * more, a + "I" * more))
        return out
    for initial, fault in symbols:
        after, late = {}, 3 if fault == "truncated" else 0
        for p, (c, a) in inserts(ways).items():
            found = [(p, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                found.append((step[p], c + 3 + late, a + "R"))
                if (initial == "s" and p == 0) or (initial == "u" and step[p] == 2) or (initial == "a" and step[p] == 3):
                    found.append((1 if initial == "s" else step[p], c + late, a + "K"))
            for q, c2, a2 in found:
                after[q] = min(after.get(q, (1 << 60, "")), (c2, a2))
        ways = after
    ends = [ways[0]] if 0 in ways else []
    return min(ends + [v for q, v in inserts(ways).items() if q == 3])


def repaired(rows, audit):
    out, at = [], 0
    led = 0
    for e in audit:
        role = ("user", "assistant")[(len(out) - led) % 2]
        if e == "I":
            out.append(f"{role}:")
            continue
        _, own, text = rows[at]
        at += 1
        if e == "K":
            led += own[:1] == "s"
            out.append(f"{own}:{text}")
        elif e == "R":
            out.append(f"{role}:{text}")
    return "\n".join(out)


def plain(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    f = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = by_states([(r[1][:1], x) for r, x in zip(rows, f)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit,
            hashlib.sha256(repaired(rows, audit).encode()).hexdigest())


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "x?\n", "", " ", None, "cut off", "é.", "same."] + [f"text {k}." for k in range(30)]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    out = [(c if c else None, rnd.choice([None, *range(longest)]), rnd.choice(roles[:rnd.choice([2, 5, 9])]), rnd.choice(texts))
           for c in range(n) for _ in range(rnd.randint(1, longest))]
    return out + [(c, t, r, "again and again.") for c in range(1000, 1040) for t, r in enumerate(["user", "assistant"] * 3)] + out[:5]


def check(spark, rows, ids=(), **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, kind int").repartition(3)
    extra = spark.createDataFrame([(i,) for i in ids], "conv_id long") if ids else None
    got = {r[0]: tuple(r)[1:] for r in R.repair(df, extra, **kw).collect()}
    want = {}
    for c, *r in rows:
        want.setdefault(c, []).append(tuple(r))
    expected = {c: plain(r) for c, r in want.items()} | {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for i in ids if i not in want}
    assert got == expected


def test_matrices_find_the_cheapest_least_audit():
    kinds = [(i, f) for i in "suax" for f in ("", "truncated")] + [("u", "blank")]
    number = {k: (9 if k[1] == "blank" else "suax".index(k[0]) + 1 + (4 if k[1] else 0)) % 9 for k in kinds}
    base = [R.symbol_matrix(s) for s in range(R.SYMBOLS)]
    rnd = random.Random(3)
    some = [s for n in range(3) for s in itertools.product(kinds, repeat=n)] + [tuple(rnd.choices(kinds, k=rnd.randint(3, 4))) for _ in range(60)]
    for symbols in some:
        chain = R.Chain()
        for s in symbols:
            chain.add(base[number[s]])
        assert chain.best() == costs(symbols) == by_states(symbols), symbols


def test_nulls_ties_repeats_and_odd_roles(spark):
    check(spark, conversations(1, 150, 9), ids=[1, 2, 5000])


def test_small_grammar_small_pieces_and_long_ropes(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 16)
    monkeypatch.setattr(R, "LEAF", 5)
    rows = conversations(2, 12, 400)
    check(spark, rows, most_rounds=2, most_pairs=3)
    check(spark, rows)


def test_a_very_long_conversation_and_a_row_repeated_often(spark):
    rnd = random.Random(4)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"t{t}" + rnd.choice([".", ""])) for t in range(12000)] + [(2, 0, "user", "Hi.")] * 9000 + [(2, 1, "assistant", "Yes.")]
    check(spark, rows)


def test_compression_loses_nothing():
    rnd = random.Random(5)
    seqs = ["".join(rnd.choices("0123", weights=[8, 4, 1, 1], k=rnd.randint(1, 60))) for _ in range(80)]
    rounds, new, rules = [], 9, {}
    for same, pairs in ((True, [(0, 0)]), (False, [(9, 1), (0, 1)]), (True, [(9, 9)])):
        rounds.append((same, R.np.array(sorted(a * R.BIG + b for a, b in pairs)), R.np.arange(new, new + len(pairs))))
        for k, p in enumerate(sorted(pairs)):
            rules[new + k] = p
        new += len(pairs)
    spell = lambda s: str(s) if s < 9 else spell(rules[s][0]) + spell(rules[s][1])
    x = R.compress(R.flat(seqs), rounds)
    assert "".join("\n" if s < 0 else spell(s) for s in x.tolist()).split("\n")[:-1] == seqs and len(x) < sum(map(len, seqs))


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, r, "A. b! c?") for c in range(60) for t, r in enumerate(["system", "user", "assistant"])] + [(None, None, None, None)]
    got = sorted(map(str, R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        h, r, x = zlib.crc32(key.encode()) % 20, " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if h == 4 else r, "" if h == 1 else "A b c" if h == 2 and x != " " else x)
        want += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    from pyspark.sql import Row
    assert got == sorted(str(Row(conv_id=a, turn=b, role=c, text=d)) for a, b, c, d in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(df, df).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ours = queries.queries()["op13_turn_repair"](spark, sf)
    sql = con.sql(queries.oracle_sql()["op13_turn_repair"])
    assert sorted(ours.columns) == sorted(sql.columns)
    assert digest(ours.columns, [tuple(r) for r in ours.collect()])[0] == digest(sql.columns, sql.fetchall())[0]
