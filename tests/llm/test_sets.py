from __future__ import annotations

import hashlib
import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from lodestrata import session
from lodestrata.llm import abuse, components, names, overlap, packing, splits
from lodestrata.llm.figures import figure
from pyspark.sql import functions as F


# --- overlaps ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "questions",
    [
        ["what was the change in net sales of Kotizumont from 2019 to 2020?", "By how mcuh did net sales at Kotizumont Airways Co. move between FY19 and FY2020 ???", "for Kotizumont， what is the differnce in net sales between fiscal 2019 and fiscal 2020?"],
        ["how much goodwill did Acmex report for 2015, in thousands of US dollars?", "what was the goodwill of Acmex in 2015 (USD thousands)?", "using the table above, for FY15, what is the reported goodwill at Acmex?"],
        ["what percent did total assets at Zed grow between 2013 and 2014?", "for Zed, how large was the percent change in total assets, 2013 to 2014?"],
        ["what is the sum of total assets at Zed over 2013 and 2014?", "for Zed, what do total assets in 2013 and 2014 add up to?"],
        ["for Zed, what is the mean rental income over 2013 and 2014?", "what was the average rental income of Zed for 2013 and 2014?"],
    ],
)
def test_wordings_of_one_figure(spark, questions):
    rows = [(str(i), *figure(q)) for i, q in enumerate(questions)]
    values = overlap.whole_names(spark.createDataFrame(rows, "key string, asked string, entity string")).collect()
    assert len(values) == len(questions) and len({r.value for r in values}) == 1


def test_other_figures_differ():
    base = "what was the change in net sales of Acmex from 2019 to 2020?"
    others = ["what was the change in net income of Acmex from 2019 to 2020?", "what was the change in net sales of Bolux from 2019 to 2020?", "what was the change in net sales of Acmex from 2018 to 2020?", "what was the percentage change in net sales of Acmex from 2019 to 2020?", "what was the average net sales of Acmex for 2019 and 2020?"]
    assert figure(base) not in {figure(o) for o in others}
    assert figure(None) is None and figure(" ") is None and figure("who wrote this?") is None


def test_firms_that_begin_alike_stay_apart(spark):
    assert figure("What were net sales of First Solar in 2019?")[1] == "first solar"
    assert figure("EBITDA of Orbex in 2019") == figure("Orbex's EBITDA for 2019") == ("value|ebitda|2019", "orbex")
    assert figure("what is the ratio of net sales to total assets at Orbex in 2019?")[1] == "orbex"
    names = ["first solar", "first energy", "first", "orbex foods", "orbex fodos", "orbex"]
    got = {r.key: r.value for r in overlap.whole_names(spark.createDataFrame([(n, "a", n) for n in names], "key string, asked string, entity string")).collect()}
    assert len({got[n] for n in names[:3]}) == 3 and len({got[n] for n in names[3:]}) == 1


WORDS = st.lists(st.sampled_from("a b c d 1 2".split()), max_size=14)


@given(WORDS, WORDS, st.integers(0, 6))
def test_words_outside_spans_equal_the_table_of_edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    assert overlap.outside_spans(a, b, most) == min(row[-1], most + 1)


def test_alike():
    a = "the net sales of the year rose by 5 percent in spite of storms".split()
    assert overlap.alike(a, a) and not overlap.alike([], []) and not overlap.alike(a, [])
    assert overlap.alike(a, "the net sales of the yaer rose by 5 percent in spite of storms".split())
    assert not overlap.alike(a, "the net sales of the year rose by 6 percent in spite of storms".split())
    assert not overlap.alike(a, "an entirely different line of words without anything".split())
    assert not overlap.alike("table 4 goodwill of acmex".split(), "table 4 goodwill of bolux".split())
    assert overlap.alike("table 4 goodwill of acmex".split(), "table 4 godwill of acmex".split())
    assert overlap.alike("table 4 goodwill of acmex".split(), "table 4 the goodwill of acmex".split())
    figures = [str(n) for n in range(100, 112)]
    assert overlap.alike(figures, figures[:5] + ["7"] + figures[6:]) and not overlap.alike(figures[:8], figures[:7] + ["7"])


def _corpus(spark):
    rnd = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame", "con") for b in ("em", "sum", "or", "us", "tet", "sec")]
    sentence = lambda: " ".join(rnd.choice(vocabulary) for _ in range(14)) + f" {rnd.randrange(100, 999)} in {rnd.randrange(2010, 2024)}."
    docs, elements = [], []
    bodies = {}
    for i in range(40):
        bodies[f"d{i}"] = [sentence() for _ in range(6)] + ["Estimates of this kind require judgment and may differ again."]
    bodies["copy"] = [s.replace(" in ", "  IN ") for s in reversed(bodies["d0"])]
    bodies["half"] = bodies["d1"][:3] + [sentence() for _ in range(4)]
    bodies["most"] = bodies["d2"][:4] + [sentence() for _ in range(3)]
    bodies["edited"] = [" ".join(w for j, w in enumerate(s.split()) if j != 4) for s in bodies["d3"]]
    bodies["changed"] = [s.replace(s.split()[14], str(int(s.split()[14]) + 1)) if s.split()[14:15] and s.split()[14].isdigit() else s for s in bodies["d4"]]
    side = {k: "train" for k in bodies} | {"copy": " TEST ", "half": "dev", "most": "Validation", "edited": "test", "changed": "test", "d39": None}
    for k, body in bodies.items():
        docs.append((k, {"split": side[k]} if side[k] else {}))
        elements += [(f"{k}:{i}", k, s) for i, s in enumerate(body)]
    docs += [("d5", {"split": "test"}), ("empty", {"split": "test"}), (None, None)]
    elements += [elements[0], (None, None, None), ("x", "d6", None), ("big", "d7", "word " * 3000)]
    d = spark.createDataFrame(docs, "document_id string, metadata map<string,string>").withColumns({"split": F.lit("zzz"), "key": F.lit(1)})
    e = spark.createDataFrame(elements, "element_id string, document_id string, source_text string").withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    return d, e


def test_documents_that_recur(spark):
    d, e = _corpus(spark)
    got = {tuple(r) for r in overlap.document_pairs(d, e).collect()}
    assert got == {("copy", "d0"), ("d2", "most"), ("d3", "edited"), ("d5", "d5")}
    assert overlap.document_pairs(d.limit(0), e).count() == 0
    assert {tuple(r) for r in overlap.document_pairs(d, e.limit(0)).collect()} == {("d5", "d5")}


def _sides(spark, rows):
    """Texts of (words, in_train, in_eval) and what brute force over all pairs links."""
    lines = {" ".join(w): (t, e) for w, t, e in rows}
    texts = spark.createDataFrame([(k, t, e) for k, (t, e) in lines.items()], "line string, in_train boolean, in_eval boolean").withColumn("text_key", F.unhex(F.md5("line")))
    expected = {(x, y) for x, (t, _) in lines.items() if t for y, (_, e) in lines.items() if e and x != y and overlap.alike(x.split(), y.split())}
    lines_of = {bytes(r.text_key): r.line for r in texts.collect()}
    return {(lines_of[bytes(r.x)], lines_of[bytes(r.y)]) for r in overlap.text_links(texts).collect()}, expected


def test_links_equal_brute_force(spark):
    """All pairs, whatever their numbers, with words changed, left out and put in."""
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("lor", "mip", "dol") for b in ("em", "sum", "or", "us")]
    rows = []
    for i in range(60):
        body = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 10, 16, 24]))] + [str(rnd.randrange(1, 40)) for _ in range(rnd.choice([0, 0, 1, 2, 4, 9, 10, 12, 21]))]
        for copy in range(4):
            words = list(body)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(words))
                words[at : at + rnd.choice([0, 1])] = rnd.choice([[], [rnd.choice(vocabulary)], [words[at][1:] + "x"], [str(rnd.randrange(40))]])
                words = words or ["x"]
            rows.append(([w for w in words if w], copy % 2 == 0, copy % 2 == 1 or rnd.random() < 0.1))
    got, expected = _sides(spark, rows)
    assert got == expected and len(expected) > 40


def test_titles_of_different_firms_do_not_meet(spark, monkeypatch):
    firms = [a + b for a in ("abcru", "defso", "ghilo", "jklma", "mnopu", "qrsti") for b in ("bandol", "fergit", "hulsek", "jomrap", "lunvex", "sitwam")]
    rows = [(f"table 3 net sales of {f}".split(), i % 2 == 0, i % 2 == 1) for i, f in enumerate(firms)]
    rows += [(line.split(), False, True) for line in ("table 3 net sales of abrcubandol", "table 3 the net sales of abcrubandol", "table 3 net sale of abcrubandol")]
    found, expected = _sides(spark, rows)
    assert found == expected and len(found) == 3
    # all that is compared, not only what is found to be alike
    monkeypatch.setattr(overlap, "_judged", lambda batches, short: (b.select(["x", "y"]) for b in batches))
    assert _sides(spark, rows)[0] == expected


def test_alike_texts_do_not_multiply_the_pairs_of_documents(spark, monkeypatch):
    """Of documents that met, rows are their elements, not the texts that each of them is alike to."""
    ends = "further modestly slightly steadily broadly again".split()
    text = "estimates of this kind require judgment and actual results may differ "
    docs = {f"t{i}": [text + e for e in ends] for i in range(3)} | {f"e{i}": [text + e for e in ends] for i in range(3)}
    d = spark.createDataFrame([(k, {"split": "train" if k[0] == "t" else "test"}) for k in docs], "document_id string, metadata map<string,string>")
    e = spark.createDataFrame([(f"{k}:{i}", k, x, "2024-01-01") for k, xs in docs.items() for i, x in enumerate(xs)], "element_id string, document_id string, source_text string, received_at string")
    rows, real = [], overlap.cut
    monkeypatch.setattr(overlap, "cut", lambda df: (rows.append((r := real(df)).count()), r)[1])
    assert overlap.document_pairs(d, e).count() == 9
    assert max(rows) <= 36


def test_a_step_leaves_no_shuffled_files(spark):
    shuffled = lambda: sum(p.stat().st_size for p in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))
    df = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).count()
    before = shuffled()
    done = session.cut(df, release=True)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and done.count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_copies_that_share_only_common_wording(spark):
    """What both share beside the wording of all texts stands between words that differ."""
    frame = [f"frame{c}" for c in "abcdefghijkl"]
    word = lambda *n: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(repr(n).encode()).hexdigest()[:9])
    rows = [(frame + [w for j in range(4) for w in (word(i, j, copy), word(i, j))], copy == 1, copy == 2) for copy in (1, 2) for i in range(60)]
    got, expected = _sides(spark, rows)
    assert got == expected and len(got) == 60


def test_documents_equal_brute_force(spark):
    """Documents of boilerplate, of own text and of both, copied with changes, repeated and missing elements; one holds a third of all."""
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit") for b in ("em", "sum", "or", "us", "tet")]
    own = lambda: [rnd.choice(vocabulary) for _ in range(12)] + [str(rnd.randrange(1000)), "in", str(rnd.randrange(2000, 2020))]
    boilerplate = [["estimates", "of", "this", "kind", *[rnd.choice(vocabulary) for _ in range(8)]] for _ in range(4)]
    docs = {}
    for i in range(24):
        docs[f"d{i}"] = [rnd.choice(boilerplate) if rnd.random() < (0.2, 0.5, 0.9)[i % 3] else own() for _ in range(rnd.choice([1, 3, 5, 8]))]
    docs["big"] = [own() for _ in range(60)]
    for name in [*docs]:
        copy = [list(e) for e in docs[name] if rnd.random() > 0.15]
        for e in copy:
            if rnd.random() < 0.4:
                e[rnd.randrange(10)] = rnd.choice(vocabulary)
        docs[f"{name}-copy"] = copy + [own() for _ in range(rnd.choice([0, 0, 1, 2]))]
    side = {k: rnd.choice(["train", "test", "dev"]) if "copy" not in k else rnd.choice(["train", "test"]) for k in docs}
    want = set()
    for t, e in ((t, e) for t in docs for e in docs if side[t] == "train" and side[e] != "train"):
        near = [[overlap.alike(x, y) for y in docs[e]] for x in docs[t]]
        n = min(sum(map(any, near)), sum(map(any, zip(*near))))
        if 2 * n > max(len(docs[t]), len(docs[e])):
            want.add((min(t, e), max(t, e)))
    d = spark.createDataFrame([(k, {"split": v}) for k, v in side.items()], "document_id string, metadata map<string,string>")
    rows = [(f"{k}:{i}", k, " ".join(e)) for k, body in docs.items() for i, e in enumerate(body)]
    e = spark.createDataFrame(rows, "element_id string, document_id string, source_text string").withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    assert {tuple(r) for r in overlap.document_pairs(d, e).collect()} == want and len(want) > 8


def test_questions_across_splits(spark):
    q = lambda n, split, text: (n, split, text)
    rows = [q(9, "train", "what was the goodwill of Acmex in 2015?"), q(10, "TEST", "how much goodwill did Acmex report for 2015?"), q(11, "Training", "how much goodwill did Acmex report for FY15?"), q(12, None, "how much goodwill did Acmex report for 2015?"), q(13, "val", None), q(9, "train", "what was the goodwill of Acmex in 2015?")]
    df = spark.createDataFrame(rows, "record_no long, split string, text string").select("record_no", "split", F.struct("text").alias("question"), F.lit(None).cast("timestamp_ntz").alias("received_at"), F.lit(1).alias("key"))
    assert {tuple(r) for r in overlap.same_figure_pairs(df).collect()} == {("10", "9"), ("10", "11")}
    others = [(1, "train", "Quel est le siège social de la société Orbex et depuis quand ?"), (2, "test", "quel est le siege social de la société Orbex et depuis quand"), (3, "val", "Quel est le capital social de la société Orbex et depuis quand ?"), (4, "val", "Quel est le siège social de la société Orbex et depuis quand ?")]
    more = spark.createDataFrame(others, "record_no long, split string, text string").select("record_no", "split", F.struct("text").alias("question"), F.lit(None).cast("timestamp_ntz").alias("received_at"), F.lit(1).alias("key"))
    assert {tuple(r) for r in overlap.same_figure_pairs(more).collect()} == {("1", "2"), ("1", "4")}


# --- groups and splits ---------------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components_equal_union_find(spark, pairs):
    parent = list(range(41))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components.components(spark.range(41).withColumnRenamed("id", "node"), edges).collect()}
    assert got == {i: find(i) for i in range(41)}


def test_a_long_chain_settles(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(spark.range(302).withColumnRenamed("id", "node"), edges)
    assert {r.component for r in got.collect()} == {0, 301}


def test_spellings(spark):
    def one(f, *values):
        rows = spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("x")).collect()
        return [r.x for r in rows]

    assert len(set(one(names.person, "Dr. Ilsa Lugolinby", "Lugolinby, Ilsa", "ILSA  LUGOLINBY", "lugolinby-ilsa"))) == 1
    assert len(set(one(names.firm, "The Zogististon Paper, Inc.", "zogististon paper plc", "ZOGISTISTON  PAPER", "Zogististon Paper Co."))) == 1
    assert len(set(one(names.folder, "A/2020/p.pdf", "./a//2020/x.PDF", "A\\2020\\y.pdf", " a/2020/z.pdf "))) == 1
    assert one(names.plain, None, " ", "-", "N/A", "Unknown author", "not stated", "none") == [None] * 7
    assert one(names.folder, "file.pdf", None, "") == [None] * 3
    assert one(names.split_name, " Train", "dev", "TEST", "valid", "other", None, "") == ["train", "validation", "test", "validation", None, None, None]


def _records(spark, n=1200):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        doc = "hot" if i % 3 == 0 and i < 300 else f"doc{rnd.randrange(n)}"
        author = rnd.choice([None, "unknown", "-", f"Ann Author{rnd.randrange(2 * n)}"])
        rows.append((i, doc, None, f"C{rnd.randrange(n)}/2020/p.pdf" if rnd.random() < 0.5 else None, author, None, rnd.choice(["train", "test", None, "Val"]), rnd.choice(["finqa", "docfinqa"]), rnd.choice(["supported", "refusal"]), True, "retrieved"))
    rows += rows[:20]
    return spark.createDataFrame(rows, "record_no long, document_id string, document_group_id string, source_file string, author string, entity string, split string, dataset string, category string, answerable boolean, context_mode string").withColumn("received_at", F.lit(None).cast("timestamp_ntz"))


def test_splits_keep_groups_and_shares(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_RECORDS", 400)
    df = _records(spark)
    out = splits.assign_splits(df).toPandas()
    assert len(out) == out.record_no.nunique() == 1200
    assert out.groupby("group_no").assigned_split.nunique().max() == 1
    share = out.assigned_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    torn = splits.groups_across_splits(df).toPandas()
    assert torn.groupby("group_no").record_no.min().eq(torn.groupby("group_no").group_no.first()).all() and len(torn)
    assert splits.assign_splits(df.limit(0)).count() == 0 and splits.groups_across_splits(df.limit(0)).count() == 0


def test_the_rarest_label_goes_first():
    need = {"a": {"": 5.0, "x": 1.0, "y": 4.0}, "b": {"": 5.0, "x": 1.0, "y": 4.0}}
    placed = splits.stratify([(1, {"": 1, "x": 1}), (2, {"": 1, "x": 1}), *((i, {"": 1, "y": 1}) for i in range(3, 11))], need)
    assert placed[1] != placed[2] and sorted(placed.values()).count("a") == 5


# --- packing -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200))
def test_packer_loses_nothing_and_overfills_nothing(sizes):
    p = packing.SumOfSquares(50)
    held: dict[int, int] = {}
    for n in sizes:
        c = p.place(n)
        held[c] = held.get(c, 0) + n
    assert all(v <= 50 for v in held.values()) and sum(held.values()) == sum(sizes)
    assert [held.get(i, 0) for i in range(len(p.levels))] == p.levels
    assert p.counts[1:].sum() == sum(v < 50 for v in p.levels)


def test_each_item_goes_where_the_sum_of_squares_is_least():
    rnd = random.Random(1)
    p = packing.SumOfSquares(12)
    for _ in range(300):
        n = rnd.randrange(1, 13)
        before, levels = p.counts.copy(), list(p.levels)
        c = p.place(n)
        def total(gap_from, gap_to):
            x = before.copy()
            if gap_from is not None:
                x[gap_from] -= 1
            if gap_to:
                x[gap_to] += 1
            return int((x.astype(int) ** 2).sum())
        options = [total(None, 12 - n)] + [total(g, g - n) for g in range(n, 12) if before[g]]
        took = total(None, 12 - n) if c == len(levels) else total(12 - levels[c], 12 - levels[c] - n)
        assert took == min(options)


def test_documents_are_packed(spark):
    rows = [(i, "net sales rose " * (i % 20)) for i in range(400)] + [(900, "word " * 1200), (901, None), (901, None), (None, "x"), (None, "x"), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit(1), "item": F.lit("x")})
    out = packing.pack_documents(df, capacity=200, packer_items=120).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 200
    assert (out.groupby(["doc_id", "copy"], dropna=False).n_tokens.sum() > 200).sum() == out[out.piece == 1].shape[0]
    assert len(out[out.piece == 0]) == len(rows)
    least = -(-out.n_tokens.sum() // 200)
    assert out.container.nunique() <= 1.1 * least + 2
    assert packing.pack_documents(df.limit(0), capacity=200).count() == 0
    named, key = df.where("doc_id IS NOT NULL"), ["doc_id", "copy", "piece"]
    once, again = (packing.pack_documents(d, capacity=200, packer_items=120).toPandas().sort_values(key).container.tolist() for d in (named, named.repartition(7)))
    assert once == again


# --- abuse ---------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def model():
    return abuse.default_model()


#: Sentences that share no frame with the seeds: abuse of every kind, and sober mentions, by language.
HELD_OUT = {
    "en": {
        1: [
            "What an absolute tool you are, nobody can stand working with you.",
            "Your work is as worthless as you are, you spineless little toad.",
            "Quit breathing our air, you dense buffoon.",
            "Screw you and everything you stand for, scumbag.",
            "If you come near my desk again I'll snap your neck.",
            "Tomorrow night we burn your car with you inside.",
            "I own a gun and you are first on my list.",
            "It would be a blessing if you got hit by a truck.",
            "You should swallow a bottle of pills and be done with it.",
            "Those filthy migrants breed like insects and ought to be wiped from the earth.",
            "Nothing good ever came from the Lurvani, a nation of crooks and degenerates.",
            "Women simply do not have the brains for finance and should stay home.",
            "Wanna hook up after work and let me see you naked?",
            "I would pay good money to watch you undress, sexy.",
            "Her bra fell to the floor as he kissed her breasts and slid inside her.",
            "He was naked and hard, and she moaned as she climbed on top of him.",
        ],
        0: [
            "The committee discussed harassment cases and dismissed two managers.",
            "Our policy on hate speech was updated in March.",
            "The accused was sentenced for threatening to kill a neighbour.",
            "Rat poison and insect traps were sold at a loss.",
            "The museum showed a nude by a local painter.",
            "Analysts who called the merger stupid were wrong.",
            "The company killed the product line and cut costs.",
            "Women hold forty percent of management positions.",
            "The hotline is open to victims of sexual violence.",
            "Migrants sent home remittances of 40 million.",
        ],
    },
    "de": {
        1: [
            "Was bist du nur für ein erbärmlicher Wicht, keiner will mit dir arbeiten.",
            "Halts Maul, du Spast.",
            "Du bist so hohl wie ein leeres Fass, du Pfeife.",
            "Scheiß auf dich und deine Zahlen, du Drecksack.",
            "Wenn du noch einmal herkommst, breche ich dir das Genick.",
            "Morgen brennt dein Auto, und du sitzt drin.",
            "Ich habe eine Waffe und du bist der Erste.",
            "Es wäre ein Segen, wenn dich ein Laster überrollt.",
            "Schluck endlich eine Packung Tabletten und stirb.",
            "Diese dreckigen Migranten vermehren sich wie Insekten und müssten ausgelöscht werden.",
            "Von den Kestriern kommt nur Gesindel und Verbrechen.",
            "Frauen haben einfach nicht genug Hirn für Finanzen, die sollen daheim bleiben.",
            "Lust auf Sex nach Feierabend, du geile Maus?",
            "Ich würde viel bezahlen, um dir beim Ausziehen zuzusehen.",
            "Ihr BH fiel zu Boden, er küsste ihre Brüste und glitt in sie.",
            "Er war nackt und hart, und sie stöhnte, als sie sich auf ihn setzte.",
        ],
        0: [
            "Der Ausschuss besprach Fälle von Belästigung und entließ zwei Leiter.",
            "Die Richtlinie gegen Hassrede wurde im März erneuert.",
            "Der Angeklagte wurde wegen Morddrohung gegen einen Nachbarn verurteilt.",
            "Rattengift und Insektenfallen wurden mit Verlust verkauft.",
            "Das Museum zeigte einen Akt eines örtlichen Malers.",
            "Das Produkt wurde eingestellt und die Kosten sanken.",
            "Frauen besetzen vierzig Prozent der Führungsstellen.",
            "Die Beratung steht Opfern sexueller Gewalt offen.",
        ],
    },
    "fr": {
        1: [
            "Quel minus tu fais, personne ne supporte de travailler avec toi.",
            "La ferme, espèce de taré.",
            "Tu es aussi creux qu'un tonneau, pauvre tache.",
            "J'emmerde tes chiffres et toi avec, sac à merde.",
            "Si tu reviens ici, je te brise la nuque.",
            "Demain ta voiture brûle, et toi dedans.",
            "J'ai une arme et tu es le premier sur ma liste.",
            "Ce serait une bénédiction si un camion t'écrasait.",
            "Avale une boîte de cachets et meurs enfin.",
            "Ces sales migrants se reproduisent comme des insectes et il faudrait les éliminer.",
            "Rien de bon ne vient des Kestriens, un peuple d'escrocs et de dégénérés.",
            "Les femmes n'ont pas assez de cervelle pour la finance, qu'elles restent chez elles.",
            "Envie de baiser après le travail, ma belle ?",
            "Je paierais cher pour te regarder te déshabiller.",
            "Son soutien-gorge tomba, il embrassa ses seins et glissa en elle.",
            "Il était nu et dur, et elle gémit en montant sur lui.",
        ],
        0: [
            "Le comité a examiné des cas de harcèlement et renvoyé deux cadres.",
            "La règle contre les discours haineux a été revue en mars.",
            "L'accusé a été condamné pour avoir menacé de tuer un voisin.",
            "La mort-aux-rats et les pièges à insectes se vendent à perte.",
            "Le musée a montré un nu d'un peintre local.",
            "La société a abandonné le produit et réduit ses coûts.",
            "Les femmes occupent quarante pour cent des postes de direction.",
            "La ligne est ouverte aux victimes de violences sexuelles.",
        ],
    },
    "es": {
        1: [
            "Qué mindundi eres, nadie soporta trabajar contigo.",
            "Cierra el pico, subnormal.",
            "Estás más hueco que un barril, pedazo de mendrugo.",
            "Me cago en tus números y en ti, saco de mierda.",
            "Si vuelves por aquí te parto el cuello.",
            "Mañana arde tu coche contigo dentro.",
            "Tengo un arma y eres el primero de mi lista.",
            "Sería una bendición que te aplastara un camión.",
            "Trágate una caja de pastillas y muérete de una vez.",
            "Esos sucios migrantes se reproducen como insectos y habría que borrarlos de la tierra.",
            "De los kestrianos solo vienen estafas y degenerados.",
            "Las mujeres no tienen cabeza para las finanzas, que se queden en casa.",
            "¿Te apetece follar después del trabajo, guapa?",
            "Pagaría mucho por ver cómo te desnudas.",
            "Su sujetador cayó al suelo, él besó sus pechos y se deslizó dentro de ella.",
            "Él estaba desnudo y duro, y ella gimió al subirse encima.",
        ],
        0: [
            "El comité trató casos de acoso y despidió a dos directivos.",
            "La norma contra el discurso de odio se revisó en marzo.",
            "El acusado fue condenado por amenazar de muerte a un vecino.",
            "El veneno para ratas y las trampas para insectos se vendieron con pérdidas.",
            "El museo expuso un desnudo de un pintor local.",
            "La empresa eliminó el producto y redujo costes.",
            "Las mujeres ocupan el cuarenta por ciento de los cargos directivos.",
            "La línea atiende a víctimas de violencia sexual.",
        ],
    },
}


@pytest.mark.parametrize("language", sorted(HELD_OUT))
def test_held_out_sentences(model, language):
    """Recall of 0.9 and at most one false alarm in each language."""
    found = {y: sum(max(model.scores(abuse.sentences(t)), default=0.0) >= abuse.THRESHOLD for t in ts) for y, ts in HELD_OUT[language].items()}
    assert found[1] >= 0.9 * len(HELD_OUT[language][1]) and found[0] <= 1


def test_held_out_sentences_are_not_among_the_seeds():
    from lodestrata.llm.abuse_seeds import labelled

    words = lambda t: " ".join(abuse.fold(t).split())
    seeds = {words(t) for t, _ in labelled()}
    assert not any(words(t) in seeds for h in HELD_OUT.values() for ts in h.values() for t in ts)


def test_held_out_frames():
    """Trained without every fifth frame and all its fillings, judged on those."""
    from lodestrata.llm import abuse_seeds

    frames = {lang: [f for line in text.strip().splitlines() for f in line.split("|")] for lang, text in abuse_seeds.ABUSIVE.items()}
    whole = dict(abuse_seeds.ABUSIVE)
    try:
        abuse_seeds.ABUSIVE = {lang: "|".join(f for i, f in enumerate(fs) if i % 5) for lang, fs in frames.items()}
        m = abuse.fit(abuse_seeds.labelled(), steps=60)
        abuse_seeds.ABUSIVE = {lang: "|".join(fs[::5]) for lang, fs in frames.items()}
        test = [t for t, y in abuse_seeds.labelled() if y]
    finally:
        abuse_seeds.ABUSIVE = whole
    assert sum(max(m.scores(abuse.sentences(t)), default=0.0) >= 0.5 for t in test) / len(test) > 0.9


def test_disguises_are_undone(model):
    score = lambda t: max(model.scores(abuse.sentences(t)))
    for t in ("You are a complete idiot.", "YOU ARE A COMPLETE IDIOT", "You are a complete 1d10t.", "You are a complete i d i o t.", "You are a complete idiooooot.", "You are a com​plete id­iot."):
        assert score(t) > 0.8


def test_long_texts_score_fast_and_dont_dilute(model):
    start = time.time()
    calm = "The balance at year end includes other items. " * 20_000
    assert max(model.scores(abuse.sentences(calm))) < 0.5
    assert max(model.scores(abuse.sentences(calm + "You are a complete idiot, go kill yourself. " + calm))) > 0.8
    abuse.sentences("a b " * 30_000)
    abuse.sentences("4@" * 30_000)
    abuse.sentences("x" * 200_000)
    assert time.time() - start < 60


def test_scores_per_row_and_source(spark, model):
    df = spark.createDataFrame([(1, "You are a complete idiot.", "a"), (1, "You are a complete idiot.", "a"), (2, None, "a"), (3, "", None), (None, "Net sales rose.", "b")], "doc_id long, text string, source string").withColumn("abuse_score", F.lit("x"))
    scored = abuse.score_documents(df, model=model)
    rows = scored.collect()
    assert len(rows) == 5 and [r.abuse_score for r in rows if r.doc_id in (2, 3)] == [0.0, 0.0]
    rates = {r.source: (r.n_documents, r.n_abusive) for r in abuse.abusive_rates(scored).collect()}
    assert rates == {"a": (3, 2), "b": (1, 0), None: (1, 0)}
    assert abuse.score_documents(df.limit(0), model=model).count() == 0
    fitted = abuse.fit_rows(spark.createDataFrame([("good work", 0), ("you idiot", 1), (None, 1)], "text string, label int"))
    assert fitted.scores(["you idiot"])[0] > fitted.scores(["good work"])[0]
