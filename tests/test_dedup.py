"""Duplicates and person groups against brute force; a third of the rows share a name."""

import random
import re
from collections import Counter

from rollcall.operators import dedup
from rollcall.operators.grams import contained

ORGS = ["", "Acme Inc", "Acme Holdings", "Holdings of Acme", "Blue Sky LLC", "Sky", "Umbra Corp", "The Umbra Company", "a"]


def people(n, seed, prefix):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = "Ana Maria Sol" if i % 3 == 0 else f"Person {chr(97 + rng.randrange(26))}"
        mail = f"M{rng.randrange(60)}@example.org" if rng.random() < 0.4 else ""
        url = f"https://www.linkedin.com/in/u{rng.randrange(60)}/" if rng.random() < 0.3 else ""
        out.append((f"{prefix}{i:04d}", f"ds{i % 3}", i, name, mail, rng.choice(ORGS), url))
    return out


def org(o):
    o = re.sub(r"(?i)\b(inc|llc|ltd|corp|co|company|the|of|for)\b\.?", "", o)
    return " ".join(re.sub(r"[^a-zA-Z\s]", "", o).split()).lower()


def brute(new, known):
    mails, urls = {}, {}
    for k in sorted(known, key=lambda k: (k[1], k[2])):
        if k[4]:
            mails[k[4].lower()] = k[0]
        if k[6]:
            urls[k[6].lower().rstrip("/")] = k[0]
    out = {}
    for n in new:
        seen = set()
        for kind, hit in (("email", mails.get(n[4].lower()) if n[4] else None), ("linkedin", urls.get(n[6].lower().rstrip("/")) if n[6] else None)):
            if hit and hit not in seen:
                seen.add(hit)
                out[(n[0], kind, 1.0)] = (1, hit)
        levels = {}
        for k in known:
            if k[3].lower() != n[3].lower() or k[0] in seen:
                continue
            a, b = org(n[5]), org(k[5])
            c = 0.6 if not a or not b else 0.9 if a in b or b in a else 0.5
            levels.setdefault(c, []).append(k[0])
        for c, ids in levels.items():
            out[(n[0], "name_org", c)] = (len(ids), None if c == 0.5 else min(ids))
    return out


def test_find_duplicates(spark):
    schema = "id STRING, dataset_id STRING, pos INT, name STRING, email STRING, organization STRING, linkedin_url STRING"
    new, known = people(120, 1, "n"), people(150, 2, "k")
    got = dedup.find_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)).collect()
    assert {(r.new_id, r.match_type, r.confidence): (r.n_existing, r.existing_id) for r in got} == brute(new, known)


def test_linked_persons(spark):
    data = [(i, d, p, n, m, o, u) for i, d, p, n, m, o, u in people(200, 3, "p")]
    parent = {r[0]: r[0] for r in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for r in data:
        keys = [("e", r[4].lower())] if r[4] else []
        keys += [("u", r[6].lower().rstrip("/"))] if r[6] else []
        keys += [("n", r[3].lower(), r[5].lower())]
        for k in keys:
            a, b = find(r[0]), find(owners.setdefault(k, r[0]))
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(data, "id STRING, dataset_id STRING, pos INT, name STRING, email STRING, organization STRING, linkedin_url STRING")
    assert {r.id: r.group_id for r in dedup.linked_persons(df).collect()} == {r[0]: find(r[0]) for r in data}


def test_person_id_uses_the_first_key(spark):
    df = spark.createDataFrame([
        ("a", "1", "X@Example.org", "", "N", "O"), ("a", "2", " x@example.org", "https://l/in/z", "M", ""), ("a", "3", "", "", "", ""), ("b", "1", "x@example.org", "", "", "")],
        "account_id STRING, id STRING, email STRING, linkedin_url STRING, name STRING, organization STRING")
    ids = [r.person_id for r in dedup.with_person_id(df).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3 and all(len(i) == 12 for i in ids)


def brute_pairs(new, known):
    mails, urls = {}, {}
    for k in sorted(known, key=lambda k: (k[1], k[2])):
        if k[4]:
            mails[k[4].lower()] = k[0]
        if k[6]:
            urls[k[6].lower().rstrip("/")] = k[0]
    out = {}
    for n in new:
        for kind, hit in (("email", mails.get(n[4].lower()) if n[4] else None), ("linkedin", urls.get(n[6].lower().rstrip("/")) if n[6] else None)):
            if hit:
                out.setdefault((n[0], hit), (kind, 1.0))
        for k in known:
            if k[3].lower() == n[3].lower():
                a, b = org(n[5]), org(k[5])
                out.setdefault((n[0], k[0]), ("name_org", 0.6 if not a or not b else 0.9 if a in b or b in a else 0.5))
    return out


def test_duplicate_tables_hold_every_pair(spark):
    """A third of the rows share a name; the tables expand to the pairs that a loop over both sides finds."""
    schema = "id STRING, dataset_id STRING, pos INT, name STRING, email STRING, organization STRING, linkedin_url STRING, known_group STRING"
    new, known = people(120, 1, "n"), people(150, 2, "k")
    frames = [spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (new, known)]
    tables = dedup.duplicate_tables(*frames)
    got = dedup.expanded(tables).collect()
    assert {(r.new_id, r.existing_id): (r.match_type, r.confidence) for r in got} == brute_pairs(new, known)
    assert len(got) == len(brute_pairs(new, known))
    # One link at most for each pair of groups, and none per pair at the lowest level.
    links = tables.links.collect()
    assert len(links) == len({(r.new_group, r.known_group) for r in links}) and all(
        (r.known_group is None) == (r.confidence == 0.5) for r in links)


def test_duplicate_tables_of_nothing(spark):
    schema = "id STRING, dataset_id STRING, pos INT, name STRING, email STRING, organization STRING, linkedin_url STRING"
    some, none = spark.createDataFrame(people(6, 1, "n"), schema), spark.createDataFrame([], schema)
    blank = spark.createDataFrame([("b", None, None, None, None, None, None)], schema)
    for new, known in ((some, none), (none, some), (blank, some), (some, blank)):
        assert dedup.expanded(dedup.duplicate_tables(new, known)).collect() == []


def test_contained_finds_what_a_loop_finds(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip()
    short = {(rng.randrange(3), word(rng.randrange(0, 6))) for _ in range(80)} | {(0, "aaaa"), (9, "zz")}
    long = {(rng.randrange(3), word(rng.randrange(0, 30))) for _ in range(80)} | {(0, "aaaaaaaa"), (0, "aaaa"), (1, "x")}
    got = contained(spark.createDataFrame([*short, (1, None), (0, "aaaa")], "k INT, s STRING"),
                    spark.createDataFrame([*long, (1, None), (0, "aaaa")], "k INT, l STRING"), ["k"], "s", "l").collect()
    want = {(k, s, x) for k, s in short for j, x in long if j == k and s and x and s in x}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_are_not_moved_once_made(spark, monkeypatch):
    """One pass of the last join makes the pairs; slices of a group lose none."""
    monkeypatch.setattr(dedup, "SLICE", 2)
    columns = ["id", "dataset_id", "pos", "name", "email", "organization", "linkedin_url"]
    new, known = people(50, 3, "n"), people(40, 4, "k")
    tables = dedup.duplicate_tables(spark.createDataFrame(new, columns), spark.createDataFrame(known, columns))
    pairs = dedup.expanded(tables)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "LeftAnti" in line and "existing_id" in line]
    got = [(r.new_id, r.existing_id) for r in pairs.collect()]
    shared = {(n[0], k[0]) for n in new for k in known if n[3] == k[3]}
    exact = {(r.new_id, r.existing_id) for r in tables.exact.collect()}
    assert len(got) == len(set(got)) and set(got) == shared | exact


def test_lists_of_a_name_meet_new_rows(spark, monkeypatch):
    """Lists of known ids are taken apart behind the last join; ids that repeat or are missing pair as often as their rows."""
    monkeypatch.setattr(dedup, "SLICE", 3)
    monkeypatch.setattr(dedup, "PART", 4)
    monkeypatch.setattr(dedup, "TASK", 50)
    schema = "id STRING, dataset_id STRING, pos INT, name STRING, email STRING, organization STRING, linkedin_url STRING"
    new, known = people(40, 5, "n"), people(45, 6, "k")
    firms = [f"firm {chr(97 + i)}{chr(122 - i)}" for i in range(12)]  # organisations of which none holds another
    new += new[:9] + [(None, "ds0", 900, "Ana Maria Sol", "", "Sky", "")] * 3 + [(f"nf{i}", "ds1", i, "Many Firms", "", f, "") for i, f in enumerate(firms)]
    known += known[:7] * 6 + [(None, "ds0", 901, "Ana Maria Sol", "", "", "")] * 5 + [(f"kf{i}", "ds1", i, "Many Firms", "", f, "") for i, f in enumerate(firms)]
    frames = [spark.createDataFrame(rows, schema) for rows in (new, known)]
    tables = dedup.duplicate_tables(*frames, stored=True)
    pairs = dedup.expanded(tables)
    exact = {(r.new_id, r.existing_id): r.match_type for r in tables.exact.collect()}
    want = Counter((*pair, kind, 1.0) for pair, kind in exact.items())
    for n in new:
        for k in known:
            if n[3] == k[3] and (n[0], k[0]) not in exact:
                a, b = org(n[5]), org(k[5])
                want[n[0], k[0], "name_org", 0.6 if not a or not b else 0.9 if a in b or b in a else 0.5] += 1
    assert Counter((r.new_id, r.existing_id, r.match_type, r.confidence) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = plan[max(i for i, line in enumerate(plan) if "name_org" in line):]
    first = next(line for line in made if "Join" in line or "Generate" in line)
    assert "Generate explode(_ids" in first


def test_pairs_follow_the_links_kept(spark):
    """Links left out of the tables make no pairs."""
    columns = ["id", "dataset_id", "pos", "name", "email", "organization", "linkedin_url"]
    new, known = people(30, 7, "n"), people(30, 8, "k")
    tables = dedup.duplicate_tables(spark.createDataFrame(new, columns), spark.createDataFrame(known, columns))
    every = [tuple(r) for r in dedup.expanded(tables).collect()]
    likely = dedup.expanded(tables._replace(links=tables.links.where("confidence > 0.7"))).collect()
    assert sorted(tuple(r) for r in likely) == sorted(r for r in every if r[3] > 0.7)
