import hashlib
import random
import re

from marlstone.llm import exact_dedup as e


def brute(rows):
    """rows: (doc_id, text); a set of results with repetitions counted."""
    groups = {}
    for at, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d or 0, at, d))
    out = []
    for text, members in groups.items():
        members.sort()
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), at == 0, digest) for at, m in enumerate(members)]
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, e.op3_exact_dedup(spark, sf_dir).collect()), key=str) == brute(docs)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, e.duplicates(odd.repartition(3)).collect()), key=str) == brute(rows)
    assert e.duplicates(nothing).count() == 0 and e.deduplicate(nothing).count() == 0


def test_deduplicate_keeps_columns(odd):
    kept = e.deduplicate(odd.coalesce(1))
    assert kept.schema.names == odd.schema.names
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "4", "5", "6", "7", "8", "9", "None", "10"])
    assert {r.doc_id: r.text for r in rows}[4] == "  lead and   runs \n\t of white space "


def test_grace_recurses_and_spills(tmp_path):
    rng = random.Random(3)
    contents = [rng.randbytes(rng.randrange(0, 40)) for _ in range(300)]
    rows = [(rng.choice([None, *range(50)]), local, rng.randrange(1, 4), rng.choice(contents)) for local in range(3000)]
    want = {}
    for d, local, n, c in rows:
        g = want.setdefault(c, [[], (True, 0, 1 << 60), 0])
        g[0].append(local)
        g[1] = min(g[1], e.first_of(d, local))
        g[2] += n
    for budget in (0, 100, 1000, 1 << 20):
        found = {c: (sorted(ls), low, keep, n) for c, ls, low, keep, n in e.grace(rows, str(tmp_path), budget)}
        assert found == {c: (sorted(g[0]), None if g[1][0] else g[1][1], g[1][2], g[2]) for c, g in want.items()}
        assert not list(tmp_path.iterdir())


def test_table_compares_contents_not_hashes():
    t = e.ContentTable()
    for n in range(2000):
        assert t.add(7, b"%d" % n, t.find(7, b"%d" % n)) == n
    assert t.find(7, b"1234") == 1234 and t.find(7, b"x") < 0


def test_large_group_of_copies(spark):
    docs = spark.range(30000).selectExpr("id doc_id", "if(id % 3 = 0, 'the  same text', cast(id as string)) text").repartition(6)
    rows = e.duplicates(docs)
    assert rows.where("kept").count() == 20001
    assert rows.where("keep_id = 0").selectExpr("count(*)", "max(group_size)", "sum(int(kept))").first() == (10000, 10000, 1)
