import itertools
import math
import random
import re

import pytest

from textloom.llm import decontamination as dec

RNG = random.Random(2)
VOCAB = ["".join(RNG.choice("etaoinshré") for _ in range(RNG.randrange(2, 8))) for _ in range(500)]


def prose(n):
    return RNG.choices(VOCAB, k=n)


def swap(words, every):
    return [w if k % every else "zzz" + w for k, w in enumerate(words, 1)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """Every placing of every item on every document."""
    out = set()
    for d, text in docs:
        w = tokens(text)
        for i, item in items:
            v = tokens(item)
            if not v:
                continue
            wide = min(len(v), dec.WINDOW)
            for diagonal in range(-len(v) + 1, len(w)):
                fits = [0 <= diagonal + k < len(w) and w[diagonal + k] == x for k, x in enumerate(v)]
                best = max(sum(fits[s : s + wide]) for s in range(len(v) - wide + 1))
                if best * 10 >= wide * 8:
                    out.add((d, i))
    return out


ITEMS = [(1, prose(40)), (2, prose(15)), (3, prose(6)), (4, prose(1)), (5, []), (6, prose(59))]
ITEMS = [(i, " ".join(w)) for i, w in ITEMS] + [(7, None), (1, " ".join(prose(30)))]
ITEMS += [(8, ITEMS[1][1].upper()), (None, ITEMS[2][1])]


@pytest.fixture(scope="module")
def cases():
    body = {i: t.split() for i, t in ITEMS[:6]}
    docs = [(k, " ".join(prose(80))) for k in range(20)]
    docs += [
        (100, " ".join(prose(30) + body[1] + prose(20))), (101, (". ".join(swap(body[1], 10)) + "!").upper()), (102, " ".join(prose(5) + swap(body[6], 7))),
        (103, " ".join(body[1][:19])), (104, " ".join(body[1][:25] + prose(10))), (105, " ".join(prose(9) + body[3])), (106, " ".join(body[2] * 3)),
        (107, None), (108, ""), (109, " ".join(prose(20_000) + body[6])), (110, body[4][0]), (111, " ".join(swap(body[1], 3))), (100, " ".join(prose(30))),
    ]
    return docs


@pytest.mark.parametrize(("seed_rows", "item_bytes"), [(dec.SEED_ROWS, dec.ITEM_BYTES), (0, dec.ITEM_BYTES), (dec.SEED_ROWS, 0)])
def test_leaks_follow_brute_force(spark, cases, seed_rows, item_bytes):
    docs = spark.createDataFrame([(*d, "x") for d in cases] + [(*cases[20], "x"), (None, cases[20][1], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dec.leaks(docs, items, seed_rows=seed_rows, item_bytes=item_bytes)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == brute([*cases, (None, cases[20][1])], ITEMS)


def test_stage_drops_rows_and_keeps_columns(spark, cases):
    docs = spark.createDataFrame([(*d, "x") for d in [*cases, (None, cases[20][1]), (None, "plain")]], "doc_id long, text string, row_key string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dec.clean(docs, items)
    assert kept.columns == docs.columns
    bad = brute([(k, d[1]) for k, d in enumerate([*cases, (None, cases[20][1]), (None, "plain")])], ITEMS)
    want = [d for k, d in enumerate([*cases, (None, cases[20][1]), (None, "plain")]) if k not in {b for b, _ in bad}]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert dec.clean(docs.limit(0), items).count() == 0
    assert dec.clean(docs, items.limit(0)).count() == docs.count()


def whole_somewhere(family, n, changed):
    """A mask of the family, laid on n words, meets none of the changed ones."""
    return any(not changed & {s + k for k, x in enumerate(m) if x == "1"} for m in family for s in range(n - len(m) + 1))


def test_no_allowed_changes_hide_an_item():
    for n in range(1, 25):
        w = min(n, dec.WINDOW)
        c = w - math.ceil(w * dec.SHARE)
        family = dec.masks_of(n)
        assert all(whole_somewhere(family, w, set(ks)) for ks in itertools.combinations(range(w), c)), n
        assert all(len(m) <= w for m in family)
        if c:
            # Real spaced seeds: places inside each mask, or in another of the family, are ignored.
            assert all("0" in m for m in family if len(family) == 1) and any("0" in m for m in family)


@pytest.mark.parametrize(("n", "c"), [(5, 1), (8, 1), (10, 2), (15, 3), (17, 3), (20, 4)])
def test_each_mask_is_needed(n, c):
    family = dec.masks_of(n)
    for gone in family:
        left = [m for m in family if m != gone]
        assert not all(whole_somewhere(left, n, set(ks)) for ks in itertools.combinations(range(n), c))


def test_other_windows_and_shares_lose_nothing():
    for window, share in ((8, 0.5), (30, 0.9), (60, 0.7)):
        for n in (3, 7, 12, 29, 70):
            w = min(n, window)
            c = w - math.ceil(w * share)
            rng = random.Random(n)
            assert all(whole_somewhere(dec.masks_of(n, window, share), w, set(rng.sample(range(w), c))) for _ in range(500))


@pytest.mark.parametrize("seed_rows", [dec.SEED_ROWS, 0])
def test_changed_items_are_found_wherever_the_changes_stand(spark, seed_rows):
    items, docs = [], []
    for n, most in ((5, 1), (9, 1), (11, 2), (12, 2), (15, 3), (20, 4)):
        body = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(body)))
        for k, changed in enumerate(itertools.combinations(range(n), most)):
            if k % 7 == 0 or 0 in changed or n - 1 in changed:
                docs.append((n * 10_000 + k, "before it " + " ".join("zzz" if i in changed else x for i, x in enumerate(body)) + " after it"))
        docs.append((n * 10_000 + 9999, " ".join("zzz" if i <= most else x for i, x in enumerate(body))))
    found = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), seed_rows=seed_rows)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, d // 10_000) for d, _ in docs if d % 10_000 != 9999}
