import pytest
from pyspark.ml.feature import StopWordsRemover

from tablesmith.functions.stem import porter, porter2
from tablesmith.queries.texts import STOP_ENGLISH

# words of the published examples of both algorithms
PORTER = """caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled
motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss
fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc
digitizer:digit radically:radic differently:differ vileli:vile analogousli:analog vietnamization:vietnam operator:oper
feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope
goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust
defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog
communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat
rate:rate cease:ceas controll:control roll:roll dying:die news:news generalizations:gener oscillators:oscil"""
PORTER2 = """consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist
consistently:consist consolation:consol consolatory:consolatori knack:knack knackeries:knackeri knavish:knavish knees:knee
kneeling:kneel knew:knew knick:knick knightly:knight knights:knight knocker:knocker knotted:knot knows:know skies:sky
dying:die generate:generat generously:generous communication:communic happily:happili cries:cri ties:tie hopping:hop
hoped:hope luxuriating:luxuri"""


@pytest.mark.parametrize("fn,table", [(porter, PORTER), (porter2, PORTER2)])
def test_published_words(fn, table):
    wrong = []
    for pair in table.split():
        word, stem = pair.split(":")
        if fn(word) != stem:
            wrong.append((word, stem, fn(word)))
    assert not wrong


def test_stop_words_of_the_oracle(spark):
    assert sorted(STOP_ENGLISH) == sorted(w.lower() for w in StopWordsRemover.loadDefaultStopWords("english"))


def test_stemming_does_not_hold_batches(spark, monkeypatch):
    from tablesmith.operators import text
    from tablesmith.plans.step import Step, apply_step

    monkeypatch.setattr(text, "KNOWN_WORDS", 3)  # forgetting words changes no stem
    df = spark.createDataFrame([(1, "Running  cities\tnationally"), (2, None), (3, ""), (4, "ponies " * 50)], "id int, t string")
    out = apply_step(df, Step("text_processing", ["t"], "stemming", {"stemmer": "snowball"}))
    got = {r["id"]: r["t_stemmed"] for r in out.collect()}
    assert got == {1: "run citi nation", 2: None, 3: "", 4: " ".join(["poni"] * 50)}
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()


def test_mean_vectors_count_words_within_texts(spark):
    from tablesmith.operators.text import mean_vectors, vector_tables

    df = spark.createDataFrame([(1, "b A b c"), (1, "a"), (2, None), (3, "x"), (4, " c  C a ")], "id int, t string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [5.0, 5.0])], "word string, vector array<double>")
    out = mean_vectors(df, "t", "id", vector_tables(df, "t", vectors), 2)
    got = sorted((r["id"], [round(x, 9) for x in r["t_embedding"]]) for r in out.collect())
    one = [round(7 / 5, 9), round(7 / 5, 9)]  # both rows of key 1: a twice, b twice, c once
    assert got == [(1, one), (1, one), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [round(11 / 3, 9), round(10 / 3, 9)])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(_k" in line and "word" in line]  # no (text, word) pairs are shuffled
