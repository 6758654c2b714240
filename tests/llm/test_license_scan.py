from __future__ import annotations

import random

import numpy as np
import pytest

from wardloom.llm import license_scan as ls
from wardloom.llm.decontaminate import plain_words


def brute(text, templates, least):
    """Every window against every template."""
    w = plain_words(text.encode())
    g = list(zip(w, w[1:], strict=False))
    out = []
    for name, t in templates.items():
        tw = plain_words(t.encode())
        q = set(zip(tw, tw[1:], strict=False))
        for a in range(len(g)):
            for z in range(a + 1, len(g) + 1):
                s = set(g[a:z])
                d = 2 * len(s & q) / (len(s) + len(q))
                if d >= least - 1e-12:
                    out.append((d, a, z - a, name))
    return out


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_best_match_equals_brute_force(least):
    rng = random.Random(5)
    templates = {"a": "licensed under the blue licence version two", "b": "released under the red licence", "c": "x y"}
    scanner = ls.Scanner(templates, least)
    vocabulary = "licensed under the blue red licence version two released x y z q".split()
    for _ in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 25))
        if rng.random() < 0.6:
            w[3:3] = templates[rng.choice("ab")].split()
        text = " ".join(w)
        found, every = scanner.matches(ls.bigrams(text.encode())), brute(text, templates, least)
        assert bool(found) == bool(every)
        if every:
            share = lambda m: round(m[0] * (len({*zip(plain_words(text.encode())[m[1] : m[1] + m[2]], plain_words(text.encode())[m[1] + 1 : m[1] + m[2] + 1], strict=True)}) + len(ls.Template("t", templates[m[3]], least).grams)) / 2)
            assert max(map(share, found)) == max(map(share, every))
        for d, a, n, name in found:
            assert any(e[1:] == (a, n, name) and e[0] == pytest.approx(d) for e in every)


def test_rows(spark, odd, nothing):
    text = "Some prose.\n" + ls.TEMPLATES["mit"] + " more prose\nLicensed under CC BY-NC 4.0.\n" + "Released under the MIT License."
    changed = ls.TEMPLATES["apache-2.0"].replace("law or agreed", "rules agreed")
    df = spark.createDataFrame([(1, text), (2, changed), (3, "nothing of the kind"), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"]) for r in ls.scan_licenses(df).orderBy("doc_id", "first_word").collect()]
    assert got == [(1, "mit"), (1, "cc-by-nc-4.0"), (1, "mit-short"), (2, "apache-2.0")]
    assert ls.scan_licenses(odd).count() == 0 and ls.scan_licenses(nothing).count() == 0
    assert ls.scan_licenses(df, templates={}).count() == 0


def test_bounds_admit_every_window_that_can_match():
    t = ls.Template("t", "one two three four five six seven eight nine ten eleven", 0.8)
    m = len(t.grams)
    for n in range(1, 3 * m):
        if 2 * min(n, m) / (n + m) >= 0.8:
            assert t.low <= n <= t.high
    assert np.all(np.diff(t.grams.astype(np.float64)) > 0)


def test_many_notices_in_one_text_cost_in_proportion():
    """Matches are set against their neighbours only: 3,200 notices (a long text) take about four times as long as 800."""
    import time

    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    seconds = []
    for n in (800, 3200):
        grams = ls.bigrams(b" ".join(b"text %d here. Licensed under the Apache License, Version 2.0." % i for i in range(n)))
        began = time.perf_counter()
        found = scanner.matches(grams)
        seconds.append(time.perf_counter() - began)
        assert len(found) == n and {m[3] for m in found} == {"apache-2.0-short"}
    assert seconds[1] < 9 * seconds[0] + 0.2


def test_every_template_finds_itself():
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    for name, text in ls.TEMPLATES.items():
        dice, _, _, found = max(scanner.matches(ls.bigrams(f"some words before {text} and some after".encode())))
        assert dice == pytest.approx(1.0) and found == name


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_matches_are_those_of_a_plain_choice(least):
    """All windows are listed and taken in order of what they share, none touching another."""
    rng = random.Random(8)
    templates = {"a": "a b c d e f g", "b": "c d e q r s", "long": "a b c d x y z c d e f g a b q r", "two": "x y"}
    scanner = ls.Scanner(templates, least)
    for _ in range(60):
        w = [x for _ in range(rng.randint(0, 6)) for x in rng.choice([*templates.values(), "n o", "a c e"]).split()]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w) + 1) : 0] = [rng.choice("abcdexyzqn")]
        text = " ".join(w)
        grams = list(zip(w, w[1:], strict=False))
        windows = []
        for d, a, n, name in brute(text, templates, least):
            q = set(zip(templates[name].split(), templates[name].split()[1:], strict=False))
            t = next(x for x in scanner.templates if x.name == name)
            if grams[a] in q and grams[a + n - 1] in q and t.low <= n <= t.high:
                windows.append((-len(set(grams[a : a + n]) & q), -d, -n, a, name))
        want = []
        for _, d, n, a, name in sorted(windows):
            if all(a - n < b or b + m < a for _, b, m, _ in want):
                want.append((-d, a, -n, name))
        assert scanner.matches(ls.bigrams(text.encode())) == sorted(want, key=lambda m: m[1])


def test_long_templates_cost_little():
    """A template of 5,600 words, whole and changed in places, inside a longer text."""
    import time

    rng = random.Random(1)
    body = [f"w{rng.randrange(900)}" for _ in range(5600)]
    scanner = ls.Scanner({"long": " ".join(body)}, 0.8)
    changed = [x if i % 40 else "other" for i, x in enumerate(body)]
    for words, least in ((body, 1.0), (changed, 0.9)):
        grams = ls.bigrams(" ".join(["before"] * 300 + words + ["after"] * 300).encode())
        began = time.perf_counter()
        found = scanner.matches(grams)
        assert time.perf_counter() - began < 2 and len(found) == 1 and found[0][0] >= least and found[0][3] == "long"
