"""Chat formatting and license scan: DuckDB twins, brute force, no Python in the plan."""
import random

import duckdb

from issuelens.llm import chat, licenses, queries

SF = "/root/testdata/sf0.01"


def twin(spark, name, *tables):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert rows and sorted(rows, key=str) == sorted(want.select(*cols).fetchall(), key=str)


def test_twins(spark):
    twin(spark, "op6_preference_chat", "conversations")
    twin(spark, "op8_license_scan", "documents")


def test_no_python_in_the_plans(spark):
    for name in ("op6_preference_chat", "op8_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_preferences(spark):
    t = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "A"), ("assistant", "B")
    df = spark.createDataFrame([(1, [u, a], [u, b]), (2, [u, a, u], [u, a]), (3, [], [u]), (4, [u], [u])],
                               f"pair_id long, chosen {t}, rejected {t}")
    got = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].prompt_turns == 1
    assert got[1].chosen == "<|assistant|>\nA<|end|>\n" and got[1].rejected == "<|assistant|>\nB<|end|>\n"
    assert [tuple(x) for x in got[1].chosen_mask] == [(len(got[1].chosen), True)]
    assert got[2].rejected == "" and got[2].chosen == "<|user|>\nhi<|end|>\n" and not got[2].chosen_mask[0].train
    assert got[3].prompt == "" and got[3].chosen == "" and got[4].chosen == got[4].rejected == ""


def test_preferences_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, turns int, n int"
    rows = [(1, 0, None, None, 1, 1), (1, 0, None, None, 1, 1), (None, 0, "user", "x", 1, 1), (2, None, "user", "", 1, 1),
            (2, 1, "assistant", None, 1, 1), (3, 0, "assistant", "p", 1, 1), (3, 1, "assistant", "q", 1, 1)]
    got = {r.pair_id: r for r in chat.format_preferences(chat.preference_pairs(spark.createDataFrame(rows, schema))).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].prompt == "<||>\n<|end|>\n" * 2 and got[1].chosen == got[1].rejected == ""
    assert got[2].chosen == "<|assistant|>\n<|end|>\n" and got[2].rejected == ""
    assert got[3].prompt == "<|assistant|>\np<|end|>\n" and "q" in got[3].chosen and "p" in got[3].rejected
    assert chat.format_preferences(chat.preference_pairs(spark.createDataFrame([], schema))).count() == 0


def test_licenses(spark, odd, none):
    rows = [(1, "a b c\nReleased under the MIT license\nd e f"), (2, "permission is granted"), (3, licenses.TEMPLATES["gpl-3.0-header"].replace(" ", "\n")),
            (4, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (5, "Licensed under a different license, version 2.0")]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, "mit", 1.0), (3, -1, "gpl-3.0-header", 1.0), (4, 0, "apache-2.0", 1.0)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert licenses.scan(odd, {"one": "word"}).count() == 0


def test_licenses_wrapped_and_embedded(spark):
    mit, bsd = licenses.TEMPLATES["mit-header"].split(), licenses.TEMPLATES["bsd-header"].split()
    wrap = lambda words, mark="": "\n".join(mark + " ".join(words[i:i + 6]) for i in range(0, len(words), 6))
    more = "\n" + " ".join(f"word{i}" for i in range(99))
    rows = [(1, "Copyright 2020\n\n" + wrap(mit) + more), (2, "# x\n" + wrap(bsd, " * ") + "\n" + wrap(mit, "// ") + more),
            (3, "Some words before it. Released under the MIT License. All rights reserved. " + "And many more words. " * 9),
            (4, "of the software of the license\n" * 30)]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 2, "mit-header", 1.0), (2, 1, "bsd-header", 1.0), (2, 5, "mit-header", 1.0),
                   (3, 0, "all-rights-reserved", 1.0), (3, 0, "mit", 1.0)]


def windows(lines, templates, percent):
    """Brute force over all windows of a text's bigrams: ``(line, end_line, license_id, dice)``, best first."""
    words = [(i, w) for i, line in enumerate(lines) for w in line.split()]
    pairs = [(a, b, f"{v} {w}") for (a, v), (b, w) in zip(words, words[1:])]
    known = {k: set(licenses.template_bigrams(v)) for k, v in templates.items()}
    every = []
    for k, v in known.items():
        for i in range(len(pairs)):
            near = []
            for j in range(i, min(i + (200 - percent) * len(v) // percent, len(pairs))):
                unit = {p for _, _, p in pairs[i:j + 1]}
                if {pairs[i][2], pairs[j][2]} <= v and 200 * len(unit & v) >= percent * (len(unit) + len(v)):
                    near.append((-2.0 * len(unit & v) / (len(unit) + len(v)), i - j, i, k, j))
            every += sorted(near)[:1]
    taken = []
    for x in sorted(every):
        if not any(y[2] <= x[4] and x[2] <= y[4] for y in taken):
            taken.append(x)
    return [(pairs[i][0], pairs[j][1], k, -minus) for minus, _, i, k, j in taken]


def test_license_windows_against_brute_force(spark):
    rng, templates = random.Random(5), {"x": "a b c d e", "y": "b c d e f g", "z": "d c b", "t": "c d"}
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) if rng.random() < 0.5 else
                          rng.choice(["a b c d", "e f g", "q a b c d e", "b c d e f", "d c b c d"]) for _ in range(rng.randint(2, 8))))
            for i in range(60)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, 80).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.license_id, round(r.dice, 9)))
    extra = 0
    for i, text in rows:
        lines = text.split("\n")

        def unit(words):
            unit = set(licenses.template_bigrams(words))
            near = [(-2.0 * len(unit & v) / (len(unit) + len(v)), k) for k, v in
                    ((k, set(licenses.template_bigrams(v))) for k, v in templates.items())
                    if 200 * len(unit & v) >= 80 * (len(unit) + len(v))]
            return min(near, default=None)
        units = {n: u for n, u in [*((n, unit(x)) for n, x in enumerate(lines)), (-1, unit(text))] if u}
        want = [(n, k, round(-minus, 9)) for n, (minus, k) in units.items()]
        for a, b, k, dice in windows(lines, templates, 80):
            if not any(u[1] == k and (n == -1 or a <= n <= b) for n, u in units.items()):
                want.append((a, k, round(dice, 9)))
                extra += 1
        assert sorted(got.get(i, [])) == sorted(want)
    assert extra > 20
