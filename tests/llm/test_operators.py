"""Each operator against a plain version or an exact round trip, and its results in awkward cases."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import fold, jaccard, leaks, near_groups, repeated_spans
from pyspark.sql import functions as F

from textquarry.llm import components, decontaminate, exact_dedup, langid, licenses, line_dedup, mixing, near_dedup, pii, queries, repeats, sharding
from textquarry.llm.common import Tables, maybe_in
from textquarry.llm.textvec import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: bool = False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:  # columns called like what operators add or use inside
        for c in ("cid", "fp", "shard", "copy", "lang_pred", "prob", "id", "mix_source", "text_copy", "root", "rank", "h"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed: int, n: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    long = prose(99, 60_000)
    return [(1, None), (2, ""), (3, "   \n "), (4, "one"), (None, "a text without an id"), (None, None), (5, "same"), (5, "same"), (6, "same"), (7, long), (8, "ünï çödé " * 3), (9, "\n\n\n"), (10, "é" * 300)]


ALL = {
    "repeats": lambda d: repeats.repeats(d),
    "sharding": lambda d: sharding.assign(d).select("doc_id", "shard"),
    "line_dedup": lambda d: line_dedup.dedupe(d),
    "pii": lambda d: pii.identifiers(d),
    "licenses": lambda d: licenses.notices(d),
    "decontaminate": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None), (None, "")], "item_id long, text string")),
    "near_dedup": lambda d: near_dedup.groups(d).drop("cid"),
    "langid": lambda d: langid.identify(d),
    "exact_dedup": lambda d: exact_dedup.duplicates(d),
    "mixing": lambda d: mixing.mix(d).select("doc_id", "source"),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](docs(spark, [])).collect() == []


SAME = {(5, 5, 3, True): 2, (6, 5, 3, False): 1}
#: What awkward() gives, and how many rows a table of three rows of nulls.
EXPECTED = {
    "repeats": ({}, 0),
    "pii": ({}, 0),
    "licenses": ({}, 0),
    "decontaminate": ({}, 0),
    "near_dedup": (SAME, 0),
    "exact_dedup": ({(5, 5, 3): 2, (6, 5, 3): 1}, 0),
    "line_dedup": (Counter((i, t, 0, 0) for i, t in awkward()), 3),
    "mixing": (Counter((i, "s") for i, _ in awkward()), 3),
    "langid": (Counter((i, "en", 1.0, True) if t and t.strip() else (i, None, 0.0, False) for i, t in awkward()), 3),
}


@pytest.mark.parametrize("name", ALL)
def test_awkward_rows_and_clashing_columns(spark, name):
    plain = Counter(map(tuple, ALL[name](docs(spark, awkward())).collect()))
    assert plain == Counter(map(tuple, ALL[name](docs(spark, awkward(), extra=True)).collect()))
    if name == "sharding":
        assert Counter(i for i, _ in plain.elements()) == Counter(i for i, _ in awkward())
        assert {s for _, s in plain} <= set(sharding.SHARDS) and len({s for i, s in plain if i is None}) == 1
    else:
        assert plain == EXPECTED[name][0]


@pytest.mark.parametrize("name", ALL)
def test_all_null_columns(spark, name):
    rows = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    found = ALL[name](rows).collect()
    assert len(found) == EXPECTED.get(name, (None, 3))[1] and len(set(found)) <= 1


# 1


SHARED, TWICE, LONG = prose(1, 80), prose(2, 60), prose(60, 600).split()
REPEATS = [(i, prose(10 + i, 40 + 10 * i)) for i in range(12)] + [
    (20, prose(50, 30) + " " + SHARED + ". " + prose(51, 20)),
    (21, prose(52, 5) + "\n" + SHARED.upper()),
    (22, SHARED),
    (23, TWICE + " x " + TWICE),
    (24, prose(53, 49)),
    (25, prose(53, 49) + " other"),
    (26, prose(54, 120)),
    (27, prose(54, 120)[5:]),
    # one long passage of two texts, of which others have parts
    (40, prose(61, 30) + " " + " ".join(LONG) + " " + prose(62, 30)),
    (41, prose(63, 40) + " " + " ".join(LONG)),
    *[(50 + i, prose(70 + i, 20) + " " + " ".join(LONG[40 * i : 40 * i + 70]) + " " + prose(90 + i, 20)) for i in range(12)],
]


@pytest.mark.parametrize(("hot", "partitions"), [(repeats.HOT, 4), (0, 4), (5, 300)])
def test_repeats_against_windows(spark, monkeypatch, hot, partitions):
    """All columns, whatever is split and however many indexes there are."""
    monkeypatch.setattr(repeats, "HOT", hot)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {(r.doc_id, r.start, r.end, r.words, r.other_id) for r in repeats.repeats(docs(spark, REPEATS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == repeated_spans(REPEATS)


def test_anchors_of_very_long_documents():
    rng = np.random.default_rng(2)
    hashed, doc = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.repeat([0, 1], [2800, 200])
    at, h = repeats.anchors(hashed, doc)
    for most in (100, 333, 2999):
        parts = repeats.anchors(hashed, doc, most=most)
        assert np.array_equal(at, parts[0]) and np.array_equal(h, parts[1])


def test_repeats_of_copies(spark):
    text = prose(3, 70)
    found = {r.doc_id: r for r in repeats.repeats(docs(spark, [(1, text), (2, text), (3, text), (9, prose(4, 70))])).collect()}
    assert sorted(found) == [1, 2, 3]
    assert [found[i].other_id for i in (1, 2, 3)] == [3, 1, 1]
    assert repeats.repeats(docs(spark, [(1, text), (1, text)])).collect() == []


def test_repeats_of_periodic_text(spark):
    rows = [(1, "a b " * 100), (2, "x " * 30)]
    found = {(r.doc_id, r.start, r.end, r.words, r.other_id) for r in repeats.repeats(docs(spark, rows)).collect()}
    assert found == repeated_spans(rows)


def test_suffix_array_and_run_index():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 300):
        tokens = np.append(rng.integers(1, 4, n), 0)
        order = repeats.suffix_array(tokens)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: tokens[i:].tolist())
        match, other = repeats.build(tokens).matching_statistics()
        for i in range(n + 1):
            best = 0
            for j in range(n + 1):
                k = 0
                while i != j and i + k <= n and j + k <= n and tokens[i + k] == tokens[j + k]:
                    k += 1
                best = max(best, k)
            assert match[i] == best
            if best:
                assert tokens[i : i + best].tolist() == tokens[other[i] : other[i] + best].tolist()


# 2


def test_shards_follow_weights_and_move_little(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before = {r.doc_id: r.shard for r in sharding.assign(d, {0: 1, 1: 1, 2: 2}).collect()}
    sizes = Counter(before.values())
    assert abs(sizes[2] / 20_000 - 0.5) < 0.02
    after = {r.doc_id: r.shard for r in sharding.assign(d, {0: 1, 1: 1, 2: 2, 3: 1}).collect()}
    moved = {k for k in before if before[k] != after[k]}
    assert all(after[k] == 3 for k in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02
    fewer = {r.doc_id: r.shard for r in sharding.assign(d, {0: 1, 2: 2}).collect()}
    assert all(before[k] == 1 for k in before if before[k] != fewer[k])


# 3


def test_line_chunks_round_trip_and_shift(spark):
    lines = [f"line {i} {i * i}" for i in range(200)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new first"] + lines)), (3, "no lines"), (4, "\n".join(lines[50:120]))]
    parts = docs(spark, rows).select("doc_id", F.explode(line_dedup.chunks("text")).alias("c")).select("doc_id", "c.no", F.col("c.text").alias("t")).collect()
    for i, text in rows:
        assert "\n".join(p["t"] for p in sorted((p for p in parts if p["doc_id"] == i), key=lambda p: p["no"])) == text
    found = {r.doc_id: r for r in line_dedup.dedupe(docs(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[3].text == "no lines"
    assert found[2].removed_lines > 150 and found[4].removed_lines > 40
    assert found[2].text.split("\n")[0] == "new first"


def test_line_chunks_of_null_ids_and_repeated_rows(spark):
    text = "\n".join(f"row {i}" for i in range(40))
    rows = [(None, text), (None, text), (None, text + "\nmore"), (7, text), (7, text)]
    found = line_dedup.dedupe(docs(spark, rows)).collect()
    assert [r.removed_lines for r in found if r.doc_id == 7] == [0, 0]
    assert all(r.removed_lines >= 35 for r in found if r.doc_id is None)


def test_line_chunks_of_equal_ids_as_their_sql(spark, tmp_path):
    """Ties between rows of one id go the same way in SQL."""
    rows = [(1, f"head {i}\n" + "\n".join(f"row {k}" for k in range(30)) + f"\ntail {i}") for i in range(6)] + [(None, "\n".join(f"row {k}" for k in range(30)))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(queries.SQL["op3_line_chunk_dedup"])
    names = [c[0] for c in rel.description]
    found = queries.QUERIES["op3_line_chunk_dedup"](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, found)) == Counter(rel.fetchall()) and sum(r.removed_lines == 0 for r in found) == 1


# 4


def planted(rng: random.Random, n: int) -> tuple[str, list[tuple[str, int, int, str]]]:
    """A text of plain words and identifiers, each written in one of its disguises; kind, place and value of each."""
    words_ = "the report was sent on monday and nobody read it before lunch while rain fell over quiet roofs".split()
    spelled = "zero one two three four five six seven eight nine".split()
    text, found = "", []

    def add(kind: str, value: str, shown: str) -> None:
        nonlocal text
        text += " ".join(rng.choice(words_) for _ in range(rng.randrange(2, 9))) + ", "
        found.append((kind, len(text), len(text) + len(shown), value))
        text += shown + ", "

    for _ in range(n):
        user, host, end = f"user{rng.randrange(99)}", f"host{rng.randrange(99)}", rng.choice(["org", "com", "io", "de"])
        mail = f"{user}@{host}.{end}"
        add("email", mail, rng.choice([mail, f"{user} at {host} dot {end}", f"{user} [at] {host} (dot) {end}", f"{user}@{host}.{end}".replace("o", "\u043e"), f"{user} @ {host}.{end}"]))
        digits = "".join(rng.sample("0123456789", 9))
        add("phone", digits, rng.choice([" ".join(spelled[int(d)] for d in digits), "-".join(spelled[int(d)] for d in digits)]))
        ip = ".".join(str(rng.randrange(10, 250)) for _ in range(4))
        add("ip", ip, rng.choice([ip, ip.replace("1", "\uff11"), ip.replace(".", "\u2024")]))
        base = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(base + d for d in "0123456789" if pii.luhn(base + d))
        add("card", card, rng.choice([card, card.translate({48 + i: 0x0660 + i for i in range(10)}), card[:8] + "\u200b" + card[8:]]))
        phone = f"+49 30 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        add("phone", phone, rng.choice([phone, phone.replace(" ", "\u00a0")]))
    return text + "the end", found


def test_pii_of_planted_identifiers(spark):
    """All that was planted, at its place, and nothing else; the query gives what a plain loop gives."""
    rng = random.Random(41)
    rows, want = [], []
    for i in range(60):
        text, found = planted(rng, rng.randrange(0, 6))
        rows.append((i, text))
        want += [(i, *f) for f in found]
    found = [(r.doc_id, r.kind, r.start, r.end, r.value) for r in pii.identifiers(docs(spark, rows)).collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("write to alice at example dot cloud", "email", "alice@example.cloud"),
        ("it was a.smith at example dot quux", "email", "a.smith@example.quux"),
        ("call five five five five five five five", "phone", "5555555"),
        ("ring 020 7946 0958 now", "phone", "020 7946 0958"),
        ("ring 07911 123456 now", "phone", "07911 123456"),
        ("tel: 612 345 678", "phone", "612 345 678"),
        ("key " + " ".join(["one two three four five"] * 5), "number", "12345" * 5),
    ],
)
def test_pii_of_any_ending_and_country(text, kind, value):
    assert [(k, v) for k, _, _, v, _ in pii.detect(text)] == [(kind, value)]


def test_pii_time_is_linear_in_finds():
    import time

    def took(n: int) -> float:
        text = " ".join(f"u{i}@h{i}.com" for i in range(n))
        begin = time.process_time()
        assert len(pii.detect(text)) == n
        return time.process_time() - begin

    took(100)
    assert took(16_000) < 16 * took(2000)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("mail me at jane.doe@example.org today", "email", "jane.doe@example.org"),
        ("mail jane (at) example [dot] org", "email", "jane@example.org"),
        ("mail jane at example dot org.", "email", "jane@example.org"),
        ("mail jane at mail dot example dot org now", "email", "jane@mail.example.org"),
        ("mail jаne@exаmple.org", "email", "jane@example.org"),
        ("call five five five one two three four five six seven", "phone", "5551234567"),
        ("call +1 555 123 4567", "phone", "+1 555 123 4567"),
        ("host 227.5.221.1 is up", "ip", "227.5.221.1"),
        ("ssn 123-45-6789", "ssn", "123-45-6789"),
        ("card 4994226020900891 ok", "card", "4994226020900891"),
        ('token = "9dd3c80004c73dc9e548fee51b23b527780d4f20"', "secret", "9dd3c80004c73dc9e548fee51b23b527780d4f20"),
        ("card ４９９４２２６０２０９００８９１", "card", "4994226020900891"),
    ],
)
def test_pii_finds(text, kind, value):
    found = pii.detect(text)
    assert [(k, v) for k, _, _, v, _ in found] == [(kind, value)]
    _, s, e, _, disguised = found[0]
    assert disguised == (text[s:e] != value)
    assert text[s:e] in text and pii.redact(text) == text[:s] + f"[{kind}]" + text[e:]


@pytest.mark.parametrize(
    ("text", "span", "value"),
    [
        ("mail john dot smith at example dot com now", "john dot smith at example dot com", "john.smith@example.com"),
        ("mail john [dot] smith [at] example [dot] com now", "john [dot] smith [at] example [dot] com", "john.smith@example.com"),
        ("mail j(dot)r.r dot tolkien (at) mail dot example.org", "j(dot)r.r dot tolkien (at) mail dot example.org", "j.r.r.tolkien@mail.example.org"),
        ("scrivi a mario at libero dot it oggi", "mario at libero dot it", "mario@libero.it"),
        ("on the dot jane@example.org", "jane@example.org", "jane@example.org"),
        ("at the dot jane at example[dot]org", "jane at example[dot]org", "jane@example.org"),
        *[(f"to jane at example dot {end}.", f"jane at example dot {end}", f"jane@example.{end}") for end in "at be us me cz in".split()],
    ],
)
def test_pii_spelled_dots_anywhere_in_addresses(text, span, value):
    assert [(k, text[s:e], v) for k, s, e, v, _ in pii.detect(text)] == [("email", span, value)]
    assert pii.redact(text) == text.replace(span, "[email]")


@pytest.mark.parametrize("text", ["look at the dot in the middle", "they arrived at a dot to be sure", "a dot at the end", "look at this dot is it"])
def test_pii_leaves_dots_in_prose(text):
    assert pii.detect(text) == []


@pytest.mark.parametrize("text", ["we met at the dot on the map", "un un un un un un un un", "version 1.2.3.4.5", "12345", "look at the dot", "one two three", "1234567890123456"])
def test_pii_leaves_clean_text(text):
    assert pii.detect(text) == []


@pytest.mark.parametrize("at", [" at ", " AT ", "@", " @ ", "(at)", " [at] ", " {at} ", " <at> ", " (@) ", "|at|", " *at* ", " arroba ", " arobase ", " arobas ", " ät ", " klammeraffe "])
@pytest.mark.parametrize("dot", [".", " dot ", " DOT ", "[dot]", " (dot) ", "[.]", " {punkt} ", " punto ", " punkt ", "|dot|"])
def test_pii_undoes_every_at_with_every_dot(at, dot):
    """Nothing else in the text has to hint at it but, between plain words, a word that speaks of mail."""
    shown = f"jane{at}mail{dot}example{dot}com"
    for before, after in (("mail ", " now"), ("", ""))[: 1 if at.strip().lower() == "at" and dot == "." else 2]:
        text = before + shown + after
        assert [(k, text[s:e], v) for k, s, e, v, _ in pii.detect(text)] == [("email", shown, "jane@mail.example.com")]
        assert pii.redact(text) == before + "[email]" + after


@pytest.mark.parametrize("dot", [" dot ", "[dot]"])
@pytest.mark.parametrize("n", [2, 32, 33, 500])
def test_pii_names_and_hosts_of_any_length(n, dot):
    name, host = [f"n{i}" for i in range(n)], [f"h{i}" for i in range(n)]
    shown = f"{dot.join(name)} at {dot.join(host)}{dot}com"
    assert [(k, v) for k, _, _, v, _ in pii.detect(f"so {shown} it is")] == [("email", f"{'.'.join(name)}@{'.'.join(host)}.com")]
    assert pii.redact(f"so {shown}, yes") == "so [email], yes"


@pytest.mark.parametrize(
    ("shown", "kind", "value"),
    [
        ("jean point dupont arobase exemple point fr", "email", "jean.dupont@exemple.fr"),
        ("jane underscore doe at my dash site dot com", "email", "jane_doe@my-site.com"),
        ("jane_dot_doe_at_example_dot_com", "email", "jane.doe@example.com"),
        ("jane (at) my (dot) info (dot) quux", "email", "jane@my.info.quux"),
        ("jane.doe at example.com", "email", "jane.doe@example.com"),
        ("\U0001d457\U0001d45c\u210e\U0001d45b@\U0001d452xample.com", "email", "john@example.com"),
        ("ja\u202ene@exa\ufe0fmple.com", "email", "jane@example.com"),
        ("jane@exa\u0336mple.com", "email", "jane@example.com"),
        ("49942260\ufe0f\u20e320900891", "card", "4994226020900891"),
        ("five five five five five five five", "phone", "5555555"),
        ("triple five triple three triple one", "phone", "555333111"),
        ("five five five 1234", "phone", "5551234"),
        ("zero 20 seven nine four six 0958", "phone", "02079460958"),
        ("five five five) one two three\nfour five six seven", "phone", "5551234567"),
        ("five/five/five/one/two/three/four", "phone", "5551234"),
        ("five   five   five one_two_three_four", "phone", "5551234"),
        ("one two three dash four five dash six seven eight nine", "phone", "123456789"),
        ("four nine nine four 2260 2090 0891", "card", "4994226020900891"),
        ("zwo eins drei vier fu\u0308nf sechs sieben", "phone", "2134567"),
        ("192 dot 168 dot 1 dot 17", "ip", "192.168.1.17"),
        ("192[.]168[.]1[.]17", "ip", "192.168.1.17"),
        ("one nine two.one six eight.one.17", "ip", "192.168.1.17"),
        ("one nine two dot one six eight dot one dot one", "ip", "192.168.1.1"),
    ],
)
def test_pii_undoes_further_disguises(shown, kind, value):
    for text in (shown, f"well {shown} it was"):
        assert [(k, text[s:e], v, d) for k, s, e, v, d in pii.detect(text)] == [(kind, shown, value, True)]


def test_pii_spelled_numbers_want_no_majority_after_a_cue():
    assert [(k, v) for k, _, _, v, _ in pii.detect("call 5 5 5 one 2 3 4 5 6")] == [("phone", "555123456")]


@pytest.mark.parametrize(
    "text",
    ["contact us at example.com", "look at example.com", "we met at one point in it", "email at example.com", "write to the office at example.com", "un, uno, un, oh, un, un, un", "one 1234567", "two 100,000", "1 dot 2 dot 3 dot 999", "1 dash 2 dash 3 dash 4", "at this point de jure"],
)
def test_pii_leaves_prose_about_sites_and_figures(text):
    assert pii.detect(text) == []


@pytest.mark.parametrize(("text", "value"), [("+49 30 123 4567, one two three", "+49 30 123 4567"), ("10.0.0.1 one two three four", "10.0.0.1"), ("jane@example.com dot then", "jane@example.com"), ("jane@example.com point v1.x", "jane@example.com"), ("jane@example.com (dot) 7", "jane@example.com"), ("x @ y point 10.0.0.1", "10.0.0.1")])
def test_pii_plain_finds_stay_beside_spelled_words(text, value):
    assert [(text[s:e], v) for _, s, e, v, _ in pii.detect(text)] == [(value, value)]


@pytest.mark.parametrize("part", ["a at ", "a dot ", "dot at dot ", "x at b.c ", "five ", "[at] ", "a @ ", "1.2.3.4.5.6.7 one ", "one dot ", "x_at_", "u at h dot com "])
def test_pii_time_is_linear_in_disguises(part):
    import time

    def took(n: int) -> float:
        begin = time.process_time()
        pii.detect(part * n + "at b dot com")
        return time.process_time() - begin

    took(100)
    assert took(16_000) < 16 * took(2000) + 0.2


def test_pii_maps_every_character_back():
    text = "x​y zero one two three four five six seven ａｂ jаne (at) exam​ple dot org"
    n = pii.normalise(text)
    assert len(n.start) == len(n.end) == len(n.text)
    assert all(0 <= a < b <= len(text) for a, b in zip(n.start, n.end)) and n.start == sorted(n.start)


# 5


def test_licenses_confirmed_by_wording(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "I need a driving license"), (5, "All rights reserved.")]
    found = {(r.doc_id, r.license) for r in licenses.notices(docs(spark, rows)).collect()}
    assert found == {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (5, "proprietary")}
    r = licenses.notices(docs(spark, rows[:1])).first()
    assert rows[0][1][r.start : r.end] == "Released under the MIT License" and r.differing == 0


def test_licenses_every_template_wins_itself():
    for name, text, _ in licenses.TEMPLATES:
        assert [x[2] for x in licenses.scan("some words\n\n" + text + "\n\nothers")] == [name], text


def test_licenses_every_notice_of_a_line():
    mit, apache, gpl = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    assert [x[2] for x in licenses.scan(f"{mit} {apache}")] == ["MIT", "Apache-2.0"]
    assert [x[2] for x in licenses.scan(f"Code: {apache} Docs: {gpl} Tests: {mit} {mit}")] == ["Apache-2.0", "GPL-3.0", "MIT", "MIT"]


def test_licenses_wrapped_and_inline_in_long_texts(spark):
    lines = [f"line {i} of a long file" for i in range(100)]
    rows, names = [], []
    for i, (name, text, _) in enumerate(licenses.TEMPLATES):
        cut = text.split()
        names.append(name)
        rows.append((4 * i, f"{prose(i, 300)} {text} {prose(i + 100, 300)}"))
        for k, at in enumerate((1, len(cut) // 2, len(cut) - 1), 1):
            wrapped = [" ".join(cut[:at]), " ".join(cut[at:])]
            rows.append((4 * i + k, "\n".join([*lines[:50], *wrapped, *lines[50:]])))
    found = {}
    for r in licenses.notices(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.differing))
    assert found == {i: [(names[i // 4], 0)] for i, _ in rows}


def test_licenses_of_reworded_copies():
    """Words left out or put in are told, one by one; the license stays the same."""
    rng = random.Random(43)
    for name, text, must in licenses.TEMPLATES:
        cut = text.split()
        free = [i for i, w in enumerate(cut) if 3 < i < len(cut) - 4 and not set(licenses._words(w)) & set(must.split()) and len(licenses._words(w)) == 1]
        if len(cut) < 60:
            continue
        gone, put = set(rng.sample(free, 4)), set(rng.sample(free, 3))
        copy = " ".join(x for i, w in enumerate(cut) for x in (([] if i in gone else [w]) + ([f"zz{i}"] if i in put else [])))
        (found,) = [x for x in licenses.scan(f"Copyright 2020 Someone\n\n{copy}\n\nint main() {{}}")]
        assert (found[2], found[4]) == (name, 7), name
        assert sorted(found[5].split()) == sorted([*("-" + licenses._words(cut[i])[0] for i in gone), *(f"+zz{i}" for i in put)])


@pytest.mark.parametrize("lines", [14, 41, 64, 500])
def test_licenses_wrapped_in_paragraphs_of_any_length(lines):
    body = [f"word{i} of a paragraph" for i in range(lines)]
    body[lines // 2 : lines // 2] = ["Licensed under the", "Apache License,", "Version 2.0."]
    assert [x[2] for x in licenses.scan("\n".join(body))] == ["Apache-2.0"]


def test_licenses_tags():
    text = "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n# SPDX-License-Identifier: MIT"
    assert [(text[s:e].split(": ")[1], name, n) for s, e, name, _, n, _ in licenses.scan(text)] == [("GPL-2.0-only WITH Classpath-exception-2.0",) * 2 + (0,), ("MIT", "MIT", 0)]


# 6


def test_decontamination_against_all_matches(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30)))) for i in range(12)]
    rows = []
    for d in range(60):
        part = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            part[5:5] = t[a : a + rng.randrange(1, 30)]
        rows.append((d, ", ".join(part).upper() if d % 3 else " ".join(part)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found: dict[int, list] = {}
    for r in decontaminate.contaminated(docs(spark, rows), bench).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    for d, text in rows:
        ours, want = sorted(found.get(d, [])), leaks(text, items)
        # spans that touch are one for the plain version
        merged = []
        for s, e in ours:
            gap = merged and not fold(text[merged[-1][1] : s])
            if gap:
                merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
        assert merged == want, (d, text)


def test_decontamination_in_several_passes(spark):
    """More items than fit one pass give the same rows; ids of other types keep them."""
    rng = random.Random(47)
    items = [(i if i else None, prose(500 + i, 20, 300)) for i in range(30)] + [(90, prose(501, 20, 300)), (91, None), (92, "")]
    rows = []
    for d in range(40):
        part = prose(700 + d, 30, 300).split()
        for i in rng.sample(range(30), d % 3):
            t = items[i][1].split()
            a = rng.randrange(6)
            part[10:10] = t[a : a + rng.randrange(10, 21)]
        rows.append((d, " ".join(part)))
    rows += [(5, items[3][1]), (None, items[4][1]), (99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows, extra=True)
    one, many = (Counter(map(tuple, decontaminate.contaminated(d, bench, pass_chars=c).collect())) for c in (10**6, 500))
    assert one == many and len(one) > 20
    one, many = (Counter(map(tuple, decontaminate.clean(d, bench, pass_chars=c).collect())) for c in (10**6, 500))
    assert one == many
    named = spark.createDataFrame([(None if i is None else f"q{i:03}", t) for i, t in items], "item_id string, text string")
    want = Counter((r.doc_id, r.start, None if r.item_id == -1 else f"q{r.item_id:03}") for r in decontaminate.contaminated(d, bench).collect())
    assert Counter((r.doc_id, r.start, r.item_id) for r in decontaminate.contaminated(d, named).collect()) == want


def test_decontamination_of_all_columns(spark):
    """tokens, item_id, item_share and doc_share as a plain count gives them."""
    items = [(i, prose(800 + i, 16 + i)) for i in range(5)]
    rows = [(i, f"{prose(820 + i, 10)} {' '.join(items[i][1].split()[2 : 2 + 13 + i % 2])} {prose(840 + i, 9)}") for i in range(5)] + [(9, items[1][1] + " " + items[2][1])]
    found = {(r.doc_id, r.start): r for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in rows[:5]:
        at = len(prose(820 + i, 10)) + 1
        r, n = found[i, at], 13 + i % 2
        assert (r.tokens, r.item_id, r.end) == (n, i, len(text) - len(prose(840 + i, 9)) - 1)
        assert r.item_share == pytest.approx(n / (16 + i)) and r.doc_share == pytest.approx(n / (19 + n))
    assert [(r.tokens, r.item_id, r.item_share, r.doc_share) for k, r in sorted(found.items()) if k[0] == 9] == [(17, 1, 1.0, 1.0), (18, 2, 1.0, 1.0)]


def test_decontamination_cleans(spark):
    item = prose(8, 20)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "before it " + item + " after it and some more words here to stay in the text"), (2, item), (3, None), (4, "clean"), (5, "")]
    out = {r.doc_id: r for r in decontaminate.clean(docs(spark, rows, extra=True), bench).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[1].text == "before it  after it and some more words here to stay in the text"
    assert out[1].n_chars == len(out[1].text) and out[3].text is None and out[4].n_chars == 5


# 7


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for g in range(15):
        base = prose(200 + g, 120).split()
        for v in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), prose(900 + i, 50)) for i in range(10)]
    found: dict[int, set[int]] = {}
    for r in near_dedup.groups(docs(spark, rows)).collect():
        found.setdefault(r.group_id, set()).add(r.doc_id)
    want = near_groups(rows)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))
    kept = {r.doc_id for r in near_dedup.keep_one(docs(spark, rows, extra=True)).collect()}
    dropped = {i for g in want for i in g} - {min(g) for g in want}
    assert kept == {r[0] for r in rows} - dropped


def test_near_groups_of_small_blocks_and_no_broadcast(spark, monkeypatch):
    """Blocks, salts and bitmaps of any size give the same groups: chains of texts that are only alike one by one."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "FOLLOWERS", 1)
    base, rows = prose(77, 60).split(), []
    for i in range(14):
        base[4 * i : 4 * i + 4] = [f"n{i}x{k}" for k in range(4)]
        rows.append((i, " ".join(base)))
    rows += [(14 + i, prose(78, 40)) for i in range(5)] + [(19 + i, prose(300 + i, 30)) for i in range(6)]
    found: dict[int, set[int]] = {}
    for r in near_dedup.groups(docs(spark, rows)).collect():
        found.setdefault(r.group_id, set()).add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, near_groups(rows)))


def test_bitmap_lets_all_keys_through(spark):
    keys = Tables(spark, "t").write(spark.range(0, 5000, 5).select(F.xxhash64("id").alias("k")))
    for bits in (64, 1 << 26):
        held = {r.id for r in spark.range(5000).where(maybe_in(keys, F.xxhash64("id"), bits)).collect()}
        assert held >= set(range(0, 5000, 5)) and (bits == 64 or len(held) < 1600)
    assert spark.range(9).where(maybe_in(keys.limit(0), F.col("id"))).count() == 0


def test_near_recall_by_similarity(spark):
    """At a similarity of .6 and more nearly all pairs are found."""
    rng, rows, pairs = random.Random(13), [], []
    for g in range(120):
        base = prose(3000 + g, 100, 100_000).split()
        other = list(base)
        for i in rng.sample(range(100), 8):
            other[i] = f"q{rng.randrange(10**6)}"
        a, b = " ".join(base), " ".join(other)
        rows += [(2 * g, a), (2 * g + 1, b)]
        if jaccard(a, b) >= 0.5:
            pairs.append(2 * g)
    found = {r.group_id for r in near_dedup.groups(docs(spark, rows)).collect()}
    assert len(pairs) > 60 and len(found & set(pairs)) >= 0.9 * len(pairs) and found <= set(pairs)


def test_sketch_estimates_similarity():
    a, b = np.arange(0, 300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    mixed = near_dedup.mix(np.concatenate([a, b]))
    s = near_dedup.sketch(mixed, np.repeat([0, 1], 300), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05
    assert (near_dedup.sketch(mixed[:1], np.zeros(1, np.int64), 1, 64) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_equal_rows_keep_one(spark):
    rows = [(1, "same text here now")] * 3 + [(2, "same text here now"), (3, None), (3, None), (4, ""), (5, ""), (6, "... !!")]
    kept = Counter(r.doc_id for r in near_dedup.keep_one(docs(spark, rows)).collect())
    assert kept == {1: 1, 3: 2, 4: 1, 6: 1}


def test_components_both_ways(spark):
    rng = random.Random(17)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = Tables(spark, "t").write(spark.createDataFrame(edges, "a long, b long"))
    one = {(r.node, r.root) for r in components.components(df, Tables(spark, "t")).collect()}
    two = {(r.node, r.root) for r in components.components(df, Tables(spark, "t"), driver_edges=0).collect()}
    loops = {(a, a) for a, b in edges if a == b}
    assert one - loops == two - loops


# 8


def test_language_held_out_accuracy(spark):
    rng = random.Random(19)
    parts = {"aa": "the of and tion ing er", "bb": "der die und keit ung sch", "cc": "le la et tion aux ère"}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(2)) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(600))]
    hidden = [(i, t, lang if i % 3 else None) for i, t, lang in rows]
    out = {r.doc_id: r for r in langid.identify(docs(spark, hidden)).collect()}
    tested = [i for i in range(600) if i % 3 == 0]
    assert sum(out[i].lang_pred == rows[i][2] for i in tested) / len(tested) > 0.97
    assert sum(out[i].accepted for i in tested) / len(tested) > 0.95


def test_language_each_text_scored_by_itself():
    texts = ["abc def", "", "xyz", "ünïcödé"]
    idf = np.ones(langid.FEATURES)
    model = langid.train(["abc def abc", "xyz xyz"] * 20, ["a", "x"] * 20, idf)
    together, sizes = model.scores(texts)
    for i, t in enumerate(texts):
        alone, n = model.scores([t])
        assert np.allclose(together[i], alone[0]) and sizes[i] == n[0]
    assert model.predict(["", "123 456"])[0] == [None, None]


def test_language_filter_keeps_columns(spark):
    rows = [(i, "the thing and the other " * 3, "en") for i in range(10)] + [(20, "12345", "en"), (21, None, "en"), (22, "", None)]
    out = langid.keep_identified(docs(spark, rows, extra=True))
    assert out.columns == docs(spark, [], extra=True).columns and sorted(r.doc_id for r in out.collect()) == list(range(10))


def test_language_sample_is_bounded_whatever_repeats(spark):
    rows = [(None, f"the thing number {chr(97 + i % 26)}{i}", "en") for i in range(3000)] + [(7, "der und die das", "de")] * 2000 + [(None, None, "en"), (1, "x", None)] + [(i, f"le mot {i}", "fr") for i in range(3)]
    texts, labels = langid.sample(docs(spark, rows), text="text", label="lang", per_language=100)
    sizes = Counter(labels)
    assert sizes["de"] == 1 and 1 <= sizes["fr"] <= 3 and 95 <= sizes["en"] <= 100 and len(set(texts)) == len(texts)
    many = [(i, f"some words {i}", f"l{i % 300}") for i in range(3000)]
    _, labels = langid.sample(docs(spark, many), text="text", label="lang", per_language=100, most=600)
    assert len(set(labels)) == 300 and len(labels) <= 600


def test_language_of_null_keys_is_learnt(spark):
    rows = [(None, t, lang) for lang, t in (("en", "the thing with all the others "), ("de", "der und die keit mit schrift ")) for t in [t * (1 + i) + chr(97 + i) for i in range(20)]]
    assert {(r.lang_pred, r.accepted) for r in langid.identify(docs(spark, rows)).collect()} == {("en", True), ("de", True)}


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 4000)
    scores = rng.normal(size=(4000, 3))
    scores[np.arange(4000), truth] += 1.0
    assert abs(langid.fit_temperature(scores * 5, truth) / langid.fit_temperature(scores, truth) - 5) < 0.2


# 9


def test_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(23)
    for n, bits in ((0, 4), (1, 0), (500, 3), (5000, 0)):
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        if bits:
            values = np.unique(values & np.uint64((1 << (64 - bits)) - 1))
        counts = rng.integers(1, 4, values.size)
        v, c = exact_dedup.decode(exact_dedup.encode(values, counts, bits))
        assert (v == values).all() and (c == counts).all()
        v, c = exact_dedup.merge([exact_dedup.encode(values, counts, bits)] * 3)
        assert (v == values).all() and (c == 3 * counts).all()


def test_exact_duplicates(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, ""), (7, ""), (None, "a"), (8, "A")]
    out = {(r.doc_id, r.keep_id, r.copies) for r in exact_dedup.duplicates(docs(spark, rows)).collect()}
    assert out == {(1, 1, 3), (2, 1, 3), (None, 1, 3), (6, 6, 2), (7, 6, 2)}


# 10


def test_water_filling_by_rounds(spark):
    rng = random.Random(29)
    sizes = {f"s{i}": rng.randrange(10, 400) for i in range(8)}
    weights = {f"s{i}": rng.choice([0.5, 1, 4, 9]) for i in range(8)}
    rows = [(i, "x" * n, "en", s) for i, (s, n) in enumerate(sizes.items())]
    found = {r.source: r.epochs for r in mixing.plan(docs(spark, rows), weights, max_epochs=2.0, budget=1.2).collect()}
    total, clamped = 1.2 * sum(sizes.values()), set()
    while True:  # clamp, redistribute, until feasible
        free = sum(weights[s] for s in sizes if s not in clamped)
        left = total - sum(2.0 * sizes[s] for s in clamped)
        share = {s: left * weights[s] / free for s in sizes if s not in clamped}
        over = {s for s in share if share[s] > 2.0 * sizes[s] + 1e-9}
        if not over:
            break
        clamped |= over
    for s in sizes:
        want = 2.0 if s in clamped else share[s] / sizes[s]
        assert found[s] == pytest.approx(want)


def test_mix_repeats_whole_and_fractional(spark):
    rows = [(i, "x" * 10, "en", "a" if i < 200 else "b") for i in range(1000)]
    out = mixing.mix(docs(spark, rows, extra=True), {"a": 1.0, "b": 1.0}, max_epochs=3.0, copy="copy").collect()
    per = Counter(r.doc_id for r in out)
    assert {per[i] for i in range(200)} == {2, 3} and abs(sum(per[i] for i in range(200)) - 500) < 40
    assert abs(sum(per[i] for i in range(200, 1000)) - 500) < 60
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)


def test_mix_of_sources_that_are_numbers(spark):
    rows = docs(spark, [(i, "x" * 10, "en", str(i % 3)) for i in range(300)])
    want = Counter((r.doc_id, int(r.source)) for r in mixing.mix(rows, {"0": 5.0, "1": 1.0}).collect())
    out = mixing.mix(rows.withColumn("source", F.col("source").cast("int")), {"0": 5.0, "1": 1.0})
    assert out.schema["source"].dataType.simpleString() == "int" and Counter((r.doc_id, r.source) for r in out.collect()) == want


# SQL and words


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = con.execute(queries.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(rel.fetchall())


def test_words_as_the_plain_version():
    texts = ["Hello, Wörld 42!", "", "a", "éà ｆｕｌｌ—width", "mixed\nlines\tand٣", "x" * 1000]
    w = words(texts)
    for i, t in enumerate(texts):
        own = w.doc == i
        assert list(zip(w.start[own].tolist(), w.end[own].tolist())) == [(s, e) for _, s, e in fold(t)]
    a, b = words(["Straight THING"]), words(["straight thing"])
    assert (a.hash == b.hash).all()
