"""Operator 3: one surrogate for all formats and titles of one entity, distinct
surrogates for distinct ones."""

import ipaddress
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

KEY = b"k"


def rewritten(spark, texts, **options):
    from riskloom.llm.pii import private_documents
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(private_documents(df, KEY, **options).collect())
    return [got[i] for i in range(len(texts))]


def test_titles_do_not_split_a_person(spark):
    texts = ["Dr Chris Miller", "Mr Chris Miller", "Ms Chris Miller", "Mr Chris MILLER", "Frau Andrea Kurz",
             "Mrs Andrea Kurz", "Mr Andrea Rossi", "Prof Anna Kurz"]
    for limit in (200_000, -1):
        got = rewritten(spark, texts, broadcast_rows=limit)
        names = [t.split() for t in got]
        assert len({n[1] for n in names[:4]}) == 1  # a man, by two titles to one
        assert {n[2] for n in names[:3]} == {names[3][2].capitalize()} and names[3][2].isupper()
        assert len({n[1] for n in names[4:7]}) == 1  # a woman
        assert names[4][2] == names[5][2] == names[7][2] != names[6][2]
        assert len({names[0][1], names[4][1], names[7][1]}) == 3
        assert [n[0] for n in names] == [t.split()[0] for t in texts]


def test_names_of_a_whole_list_stay_distinct_regular_names(spark):
    from riskloom.llm.pii import _POOL, GIVEN, detect, part_of
    texts = [" and ".join(f"{n} Xylo" for n in names) for names in GIVEN.values()]
    got = rewritten(spark, texts)
    made = set()
    for (script, g), old, new in zip(GIVEN, texts, got):
        first = [x.split()[0] for x in new.split(" and ")]
        assert len(set(first)) == len(first) and not set(first) & set(GIVEN[script, g])
        at = {"latin": 0, "cyrillic": 2, "greek": 4}[script]
        regular = {x.lower() for x in _POOL[at, g]}
        assert sum(x.lower() in regular for x in first) > len(first) / 2
        made |= set(first) | {x.split()[1] for x in new.split(" and ")}
    values = {t[a:b] for t in texts for a, b, k in detect(t) if part_of(k) in ("given", "surname")}
    assert len(made) == len(values) and not made & values


def test_formats_of_one_entity(spark):
    texts = ["Card 4111111111111111.", "Card 4111 1111 1111 1111.", "Card 4111-1111-1111-1111.",
             "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "+49 30 1234567", "+49-30-1234567",
             "(030) 1234567", "030 1234567", "Ann.B@Mail.Example.com", "ann.b@mail.example.com",
             "Frau MÜLLER-LÜDENSCHEIDT", "Frau Müller-Lüdenscheidt", "Mr McDonald", "Mr O'Neil",
             "Mr O’NEIL", "2001:db8::1", "2001:DB8::1"]
    got = rewritten(spark, texts)
    plain = [re.sub(r"[ .()-]", "", t).lower().replace("’", "'") for t in got]
    assert all(a != b for a, b in zip(got, texts))
    for same in ((0, 1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (14, 15), (16, 17)):
        assert len({plain[i] for i in same}) == 1, [got[i] for i in same]
    shape = lambda t: re.sub(r"\w", "x", t)
    for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10):
        assert shape(got[i]) == shape(texts[i])
    assert got[11].removeprefix("Frau ").isupper() and got[12].count("-") == 1
    mc = got[13].removeprefix("Mr ")
    assert [i for i, c in enumerate(mc) if c.isupper()] == [0, 2]
    assert re.fullmatch(r"Mr [A-Z]'[A-Z][a-z]+", got[14]) and re.fullmatch(r"Mr [A-Z]’[A-Z]+", got[15])
    assert all(ipaddress.ip_address(got[i]).version == 6 for i in (16, 17)) and got[17].isupper()


def test_new_forms_are_found_and_others_left_alone():
    import pyarrow as pa
    from riskloom.llm.pii import _candidates, detect
    found = lambda t: [(t[a:b], k) for a, b, k in detect(t)]
    assert found("at 2001:db8::1, fe80:0:0:0:1:2:3:4.") == [("2001:db8::1", "ip"),
                                                            ("fe80:0:0:0:1:2:3:4", "ip")]
    assert found("call (030) 1234567 or 030 123456 or 030/123456") == [
        ("(030) 1234567", "phone"), ("030 123456", "phone"), ("030/123456", "phone")]
    for t in ("12:30:45", "std::cout << abc::def", "00:1b:44:11:3a:b7", "pages 030 12", "a::b", "1:2:3",
              "Cafe::bar", "0.30 12345", "MÜLLER", ""):
        assert found(t) == [], t
    r = random.Random(3)
    bits = ["(0", "0", "30", ")", " ", "/", "-", "12345", "678", "2001", "db8", ":", "::", "1", "fe80", ".", "Mr",
            "MÜLLER", "O’", "Anna"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(2, 14))) for _ in range(40_000)]
    kept = set(_candidates(pa.array(texts)))
    hits = [i for i, t in enumerate(texts) if detect(t)]
    assert len(hits) > 1000 and kept.issuperset(hits)


def brute(mentions, key):
    """The rounds of proposals over all identities at once."""
    from riskloom.llm.pii import identity, part_of, surrogate
    votes, value, kinds = defaultdict(Counter), {}, {}
    for k, v in mentions:
        i = part_of(k), identity(k, v)
        votes[i][k[-1]] += 1
        value[i], kinds[i] = min(v, value.get(i, v)), k
    for i, c in votes.items():
        if i[0] == "given":
            kinds[i] = "given_" + ("f" if c["f"] > c["m"] else "m" if c["m"] > c["f"] else "u")
    among = lambda p: "name" if p in ("given", "surname") else p
    taken = {(among(p), x) for p, x in value}
    todo, attempt, out = set(value), 0, {}
    while todo:
        made = {i: (among(i[0]), identity(kinds[i], surrogate(key, kinds[i], value[i], attempt)))
                for i in todo}
        first = {}
        for i in sorted(todo):
            first.setdefault(made[i], i)
        good = {i for m, i in first.items() if m not in taken}
        taken |= {made[i] for i in good}
        out.update({i: (kinds[i], attempt) for i in good})
        todo, attempt = todo - good, attempt + 1
    return {(k, v): out[part_of(k), identity(k, v)] for k, v in mentions}


def test_rounds_equal_brute_force(spark):
    from riskloom.llm.pii import resolved
    r = random.Random(5)
    names = ["".join(r.choice("aeiou" if i % 2 else "bdklmn") for i in range(4)).capitalize() for _ in range(300)]
    mentions = [(r.choice(["given_f", "given_m", "given_u", "surname"]), n)
                for n in names for _ in range(r.randrange(1, 5))]
    mentions += [("surname", n.upper()) for n in names[:50]]
    mentions += [("ip", f"{a}.{b}.1.1") for a in range(1, 9) for b in range(1, 9)]
    mentions += [("email", x) for x in ("a@b.de", "A@b.de", "c@b.de")] * 2
    df = spark.createDataFrame(mentions, "kind string, value string").withColumn("n", F.lit(1)).repartition(5)
    got = {(x["kind"], x["value"]): (x["as_kind"], x["attempt"]) for x in resolved(df, KEY).collect()}
    assert got == brute(mentions, KEY)
    assert max(a for _, a in got.values()) > 0
    assert resolved(df.limit(0), KEY).count() == 0
