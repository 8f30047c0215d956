import re

from textloom.llm import surrogates

TEXTS = [
    (1, "write to Jane.Doe7@mail.site.org or jane.doe7@mail.site.org, not bob@site.org."),
    (2, "call +1 (017) 555-7713, +1 017 555 7713 or (212) 555-0199; card 4845 1681 1440 7329 = 4845168114407329"),
    (3, "host 10.0.0.1 and 10.0.0.2; version 1.2.3 and 1234; ssn 123-45-6789"),
    (4, "Mr. John Smith met Mrs Smith, Herr Weber and Г-жа Анна Иванова. Mister smith did not."),
    (5, None), (6, ""), (7, "nothing at all"), (8, "x" * 60_000 + " a@b.example"), (1, "bob@site.org again"), (1, "bob@site.org again"), (None, "bob@site.org"),
    (9, 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd12"'),
]


def run(spark, texts=TEXTS, key="k"):
    df = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, surrogate string")
    return surrogates.replace(df, key)


def test_consistent_formats_and_coreference(spark):
    out = run(spark)
    assert out.columns == ["doc_id", "text", "surrogate", "n_entities"]
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    t = by[1][0].text if by[1][0].text.startswith("write") else next(r.text for r in by[1] if r.text.startswith("write"))
    a, b, c = re.findall(r"\S+@[\w.]+\w", t)
    assert a == b != c and "bob@site" not in t and re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@m[0-9a-f]{8}\.example\.org", a)
    again = {r.text for r in by[1] if "again" in r.text}
    assert again == {f"{c} again"} and by[None][0].text == c
    t = by[2][0].text
    p = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}|\(\d{3}\) \d{3}-\d{4}", t)
    assert len(p) == 3 and re.sub(r"\D", "", p[0]) == re.sub(r"\D", "", p[1]) and "555-7713" not in t
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", t)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] != "4845168114407329"
    t = by[3][0].text
    ips = re.findall(r"(?:\d+\.){3}\d+", t)
    assert len(set(ips)) == 2 and all(0 <= int(x) < 256 for ip in ips for x in ip.split(".")) and "version 1.2.3 and 1234" in t and "123-45-6789" not in t
    t = by[4][0].text
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+), Herr (\w+) and Г-жа (\w+) (\w+)\. Mister smith did not\.", t)
    assert m and m[2] == m[3] != m[4] and m[1] in surrogates.GIVEN["m", "latin"] and m[5] in surrogates.GIVEN["f", "cyrillic"] and re.fullmatch("[А-я]+", m[6])
    assert by[5][0].text is None and [by[k][0].text for k in (6, 7, 9)] == ["", "nothing at all", TEXTS[-1][1]]
    assert by[8][0].text.startswith("x" * 60_000) and by[8][0].n_entities == 1 and by[7][0].n_entities == 0
    assert run(spark, []).count() == 0


def test_distinct_entities_stay_distinct(spark):
    ips = [f"1.2.{k // 250}.{k % 250}" for k in range(3000)]
    names = [f"Mr {chr(65 + k % 26)}{''.join(chr(97 + (k * p) % 26) for p in (3, 7, 11, 17))}" for k in range(400)]
    texts = [(k, f"see {x}, ok") for k, x in enumerate([*ips, *names, *[f"a{k}@x.com" for k in range(300)]])]
    new = {}
    for r in run(spark, texts).collect():
        assert r.n_entities == 1
        new[r.doc_id] = r.text
    old = {t for _, t in texts}
    kinds = {}
    for k, t in texts:
        kinds.setdefault(re.sub("Mr ", "", t).lower(), set()).add(new[k])
    assert all(len(v) == 1 for v in kinds.values()) and len(set(new.values())) == len(kinds)
    assert not old & set(new.values())
    assert run(spark, texts[:50], key="other").select("text").first()[0] != new[0]


def test_whole_names_and_spaced_numbers_are_replaced(spark):
    numbers = ["+33 1 23 45 67 89", "+49 30 12 34 56", "+45 12 34 56 78", "+33-6-12-34-56-78"]
    names = ["Mr McDonald", "Mr. Juan Carlos Lopez", "Mrs O'Brien", "Ms D’Arcy-Jones", "Mr J. R. Smith", "Mr. J.R. Smith", "Herr Otto von der Heide", "Mr van Dyke", "Mr Jean-Paul Petit Dupont"]
    texts = [(k, f"so {x}, then") for k, x in enumerate([*numbers, *names])] + [(99, "from Mr Smith Mrs Jones Miss Ann Lee")]
    out = {r.doc_id: r for r in run(spark, texts).collect()}
    for k, x in enumerate([*numbers, *names]):
        t = out[k].text
        assert out[k].n_entities == 1 and t.startswith("so ") and t.endswith(", then") and x not in t
        assert not set(re.findall(r"[^\W\d_]{2,}", x.partition(" ")[2])) & set(re.findall(r"[^\W\d_]+", t))
        assert k >= len(numbers) or re.sub(r"\d", "0", t[3:-6]) == re.sub(r"\d", "0", x)
    assert out[99].n_entities == 3 and re.fullmatch(r"from Mr [A-Z]\w+ Mrs [A-Z]\w+ Miss [A-Z]\w+ [A-Z]\w+", out[99].text)
    every = spark.createDataFrame([(t,) for _, t in TEXTS + texts], "text string")
    assert every.filter(every.text.rlike(surrogates.MASTER) & ~every.text.rlike(surrogates.HINT)).count() == 0


def test_written_forms_stay_distinct(spark):
    given = ["".join(chr(97 + (k * p) % 26) for p in (1, 3, 5)).capitalize() + "abcdefghij"[k % 10] for k in range(60)]
    names = [*(f"Mr {g} Smith" for g in given), *(f"Mrs {g} Smith" for g in given[:20]), "Mr Smith"]
    numbers = [f"+45 {10 + k // 90} {10 + k % 90}" + " 11" for k in range(2000)]
    texts = [(k, x) for k, x in enumerate([*names, *numbers])]
    new = {r.doc_id: r.text for r in run(spark, texts).collect()}
    assert len(set(new.values())) == len(set(names + numbers)) and not set(new.values()) & set(names + numbers)
    assert len({new[k].split(" ")[-1] for k in range(len(names))}) == 1
    assert all(new[k].startswith("+45 ") for k in range(len(names), len(texts)))
    same = run(spark, [(1, "+33 1 23 45 67 89"), (2, "+33123456789"), (3, "Mr J. Smith"), (4, "Mr. J Smith")])
    t = {r.doc_id: re.sub(r"\W", "", r.text) for r in same.collect()}
    assert t[1] == t[2] and t[3] == t[4]
