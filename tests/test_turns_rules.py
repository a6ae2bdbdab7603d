import random
import re

import pytest
from pyspark.sql import functions as F

from tertulia.config import RuleSet
from tertulia.operators import rules as R
from tertulia.operators import turns as W

TURN_SCHEMA = (
    "archivo string, turn_no int, speaker string, speaker_num int, timestamp string, start_sec int, text string"
)
RULES = RuleSet(
    {
        "MOMENT": {"later": [r"\bcuando (pueda|se libere)\b", "despues"]},
        "USE": {"enough": [r"\bno (lo )?necesito\b"], "other": ["subió", "ya (uso|tengo)"]},
    },
    {"later": 2, "enough": 3},
)


@pytest.fixture
def turns(spark):
    def make(*items):
        rows = [
            (call, n, f"Speaker {who}", who, f"0:{second:02d}", second, text)
            for call, n, who, second, text in items
        ]
        return spark.createDataFrame(rows, TURN_SCHEMA)

    return make


def hot_call(count, seed=7):
    rng = random.Random(seed)
    long = [("hot", i, rng.randint(1, 3), rng.randint(0, 59), f"t{i} " + "x" * rng.randint(0, 9)) for i in range(count)]
    short = [(f"c{k}", i, 1 + i % 2, i, f"{k}-{i}") for k in range(5) for i in range(k + 1)]
    return long + short


@pytest.mark.parametrize("block", [2, 3, 7, 1024])
def test_neighbours_across_blocks(turns, block):
    items = hot_call(40)
    texts = {(c, n): text for c, n, _, _, text in items}
    starts = {(c, n): second for c, n, _, second, _ in items}
    seen = W.with_duration(W.with_context(turns(*items), 4, block), block).collect()
    assert len(seen) == len(items)
    for r in seen:
        before, after = (r.archivo, r.turn_no - 1), (r.archivo, r.turn_no + 1)
        assert r.context_before == texts.get(before, "")[:4]
        assert r.context_after == texts.get(after, "")[:4]
        assert r.duration_sec == max(0, starts.get(after, 0) - r.start_sec if after in starts else 0)


def test_hot_call_is_spread_over_tasks(spark):
    df = spark.range(20000).selectExpr("'hot' AS archivo", "CAST(id AS int) AS turn_no", "'x' AS text")
    seen = W.with_context(df, 1, block=500).select(F.spark_partition_id().alias("p")).distinct().count()
    assert seen > 1


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_number_turns(spark, block, monkeypatch):
    monkeypatch.setattr(W, "SUPERBLOCK", 3)
    places = [0, 1, 2, 5, 6, 9, 40, 41, 1000]
    rows = [(call, p) for call in ("a", "b", None) for p in places if call != "b" or p % 2]
    df = spark.createDataFrame(rows, "archivo string, place int")
    got = {(r.archivo, r.place): r.turn_no for r in W.number_turns(df, "place", block).collect()}
    for call in ("a", "b", None):
        mine = sorted(p for c, p in rows if c == call)
        assert [got[call, p] for p in mine] == list(range(len(mine)))


def test_objections(turns):
    table = turns(
        ("a", 0, 2, 0, "¿Cómo le va?"),
        ("a", 1, 1, 3, "Después, cuando pueda. NO LO NECESITO"),
        ("a", 2, 2, 9, "ya tengo"),
        ("a", 3, 1, 12, "Subió; ya uso otro"),
        ("b", 0, 1, 0, "nada"),
    )
    got = R.detect_objections(table, RULES, 1, context_size=5).orderBy("archivo", "turn_no", "rule_no").collect()
    assert [(r.turn_no, r.type, r.category, r.intensity, r.matched_text, r.pattern) for r in got] == [
        (1, "MOMENT", "later", 2, "cuando pueda", r"\bcuando (pueda|se libere)\b"),
        (1, "USE", "enough", 3, "no lo necesito", r"\bno (lo )?necesito\b"),
        (3, "USE", "other", 1, "ya uso", "ya (uso|tengo)"),
    ]
    assert (got[0].timestamp, got[0].speaker, got[0].full_text) == ("0:03", "Speaker 1", "Después, cuando pueda. NO LO NECESITO")
    assert [(r.context_before, r.context_after) for r in got] == [("¿Cómo", "ya te"), ("¿Cómo", "ya te"), ("ya te", "")]


def test_accented_rule_never_matches(turns):
    only = RuleSet({"USE": {"other": ["subió"]}})
    assert R.rule_objections(turns(("a", 0, 1, 0, "subió subio")), only).count() == 0


@pytest.mark.parametrize("size", [1, 50])
def test_the_number_of_rules_changes_nothing(turns, size):
    hard = [r"fin$", r"uno.dos", r"[b&&c]", r"\bñu\b", r"a\Z", r"x{,2}y", r"[[:]", r"\s\S", r"{a}"]
    rules = RuleSet({"T": {f"c{i}": [p] for i, p in enumerate(hard)}})
    texts = ["fin\r", "fin\n", "uno\u2028dos", "uno\ndos", "b", "&", "el ñu va", "ñus", "a", "a\n", "xxxy", "[", "\x1cq", "{a}"]
    table = turns(*[("a", i, 1, i, text) for i, text in enumerate(texts)])
    got = R.match_rules(table, rules, categories_per_column=size).orderBy("turn_no").collect()
    for r, text in zip(got, texts, strict=True):
        assert {h.pattern for h in r.hits} == {p for p in hard if re.search(p, text)}, text
    assert "ArrowEvalPython" not in R.match_rules(table, rules)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", [r"(?P<n>a)", r"(?a)\w", r"(?x) a", r"[\W]", r"(a)(?(1)b|c)", r"\012", "(?#no)a"])
def test_patterns_without_a_counterpart_are_refused(pattern):
    with pytest.raises(ValueError):
        RuleSet({"T": {"c": [pattern]}})


def test_neighbours_do_not_depend_on_gaps_or_blocks(turns):
    numbers = [1, 3, 1022, 1025, 5000, 5001]
    table = turns(*[("a", n, 1, n, f"t{n}") for n in numbers])
    for block in (1, 2, 7, 1024):
        got = W.with_duration(W.with_context(table, 10, block), block).orderBy("turn_no").collect()
        assert [r.context_before for r in got] == ["", *(f"t{n}" for n in numbers[:-1])]
        assert [r.context_after for r in got] == [*(f"t{n}" for n in numbers[1:]), ""]
        assert [r.duration_sec for r in got] == [2, 1019, 3, 3975, 1, 0]


def test_quotes_and_backslashes_in_rules(turns):
    odd = RuleSet({"A'B": {"c\\d": [r"it's \d+", "a\\\\b", '"q"']}})
    table = turns(("a", 0, 1, 0, "it's 42"), ("a", 1, 1, 0, r"a\b"), ("a", 2, 1, 0, 'say "q"'))
    got = R.rule_objections(table, odd).orderBy("turn_no").collect()
    assert [(r.type, r.category, r.matched_text) for r in got] == [
        ("A'B", "c\\d", "it's 42"),
        ("A'B", "c\\d", r"a\b"),
        ("A'B", "c\\d", '"q"'),
    ]


def test_rules_match_without_join(turns):
    plan = R.rule_objections(turns(("a", 0, 1, 0, "x")), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Exchange" not in plan


def test_client_per_call(spark, turns):
    table = turns(("a", 0, 1, 0, "despues"), ("a", 1, 2, 0, "despues"), ("b", 0, 1, 0, "despues"), ("b", 1, 2, 0, "despues"))
    clients = spark.createDataFrame([("a", 2)], "archivo string, client int")
    got = R.detect_objections(table, RULES, 1, clients).orderBy("archivo").collect()
    assert [(r.archivo, r.turn_no) for r in got] == [("a", 1), ("b", 0)]


def test_intensity_table(spark, turns):
    found = R.rule_objections(turns(("a", 0, 1, 0, "despues no necesito")), RULES)
    levels = spark.createDataFrame([("enough", 9)], "category string, intensity int")
    got = {r.category: r.intensity for r in R.with_intensity(found, levels).collect()}
    assert got == {"later": 1, "enough": 9}


def test_rule_checks(spark):
    with pytest.raises(ValueError):
        RuleSet({"A": {"b": [r"(?P<name>x)"]}})
    R.check_rules(spark, RULES)
    with pytest.raises(Exception):
        R.check_rules(spark, RuleSet({"A": {"b": [r"x(?#note)y"]}}))
    rows = R.rules_table(spark, RULES).orderBy("type_ord", "category_ord", "pattern_ord").collect()
    assert [r.pattern for r in rows] == [rule.pattern for rule in RULES.rules()]
    assert R.match_rules(spark.range(1).select(F.lit("x").alias("text")), RuleSet({})).first()["hits"] == []


@pytest.mark.parametrize(
    "pattern, texts",
    [
        ("(than|then)[a-z]* (the|of)", {"than", "then"}),
        ("[abc]{2}rest", {"rest"}),
        ("(a|b)(c|d)(e|f)(g|h)(i|j)", {a + c + e + g for a in "ab" for c in "cd" for e in "ef" for g in "gh"}),
        (r"\bno (me )?interesa\b", {"no interesa", "no me interesa"}),
        ("abc+de", {"ab"}),
        ("(?:foo|ba[rz])x", {"foox", "barx", "bazx"}),
        ("a*", None),
        ("x?yz|q", {"xyz", "yz", "q"}),
        ("(?i)abc", None),
        ("(?i:abc)def", {"def"}),
        ("(?=lookahead)no", {"no"}),
        ("(?!not)yes", {"yes"}),
        ("[a]bc", {"abc"}),
        (r"(ab)\1", {"ab"}),
        ("(long|)", None),
        (r"\.\+", {".+"}),
    ],
)
def test_required_texts(pattern, texts):
    from tertulia.functions.patterns import required_texts

    assert required_texts(pattern) == texts


def test_gated_rules_find_the_same(spark, monkeypatch):
    import random

    from tertulia.operators import reports

    rng = random.Random(8)
    stems = ["caro", "luego", "precio alto", "no me interesa", "dudas", "hoy", "mañana", "otro proveedor", "más tarde"]
    forms = ["{}", r"\b{}\b", "({}|{})", "{}[a-z]*", "(?:muy )?{}", "[0-9]+ {}", ".", "{}?", "(?i){}", "xx{}"]
    pattern = lambda: rng.choice(forms).format(rng.choice(stems), rng.choice(stems))
    found = {t: {f"{t}{c}": [pattern() for _ in range(rng.randrange(1, 40))] for c in range(4)} for t in "ABC"}
    large = RuleSet(found, {"A1": 3})
    assert len(large.rules()) >= R.GATED_RULES
    texts = [" ".join(rng.choice([*stems, "hola", "7", "x"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    turns = spark.createDataFrame([("a", i, 1, t) for i, t in enumerate([*texts, None, "", "abc"])], "archivo string, turn_no int, speaker_num int, text string")
    call = "".join(f"Speaker 1: {{ 0:{i:02d} }}\n{t}\n" for i, t in enumerate(texts[:30]))
    calls = spark.createDataFrame([("a", call)], "archivo string, raw string")
    shown = lambda df: sorted(map(str, df.collect()))
    gated = [shown(R.match_rules(turns, large)), shown(reports.call_documents(calls, large))]
    monkeypatch.setattr(R, "GATED_RULES", 1 << 30)
    assert gated == [shown(R.match_rules(turns, large)), shown(reports.call_documents(calls, large))]
