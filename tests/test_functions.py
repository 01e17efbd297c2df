import pytest
from pyspark.sql import functions as F

from tests.helpers import value
from veritrim.functions import casts, metrics, prompts, text, vectors
from veritrim.schemas import PROMPT_TAIL, Settings


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Hello,  World!\n", "hello world"),
        ("a b", "a b"),
        ("a \u0085\x1cb", "a b"),
        ("“quoted” it's", "“quoted” its"),
        ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""),
        ("ÉTÉ ß", "été ß"),
        ("  ", ""),
    ],
)
def test_normalize_text(spark, raw, expected):
    assert value(spark, text.normalize_text(lit(raw))) == expected


@pytest.mark.parametrize("raw", ["  x　\n", "\x1f x\x85", "x"])
def test_strip_removes_white_space_of_any_script(spark, raw):
    assert value(spark, text.strip(lit(raw))) == raw.strip() == "x"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("-1,234.50", "-1234.50"),
        ("12, 13.", "13."),
        ("5-3", "-3"),
        ("no", None),
        ("", None),
        (None, None),
        ("٣ and ٤٥", "٤٥"),
        ("1.2.3", "3"),
    ],
)
def test_last_number(spark, raw, expected):
    assert value(spark, text.last_number(lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("2+2 #### 4", "4"), ("a #### b #### c \n", "c"), (" plain ", "plain"), ("x ####", ""), ("##### 7", "# 7")],
)
def test_final_answer(spark, raw, expected):
    assert raw.split("####")[-1].strip() == expected
    assert value(spark, text.final_answer(lit(raw))) == expected


def test_tokens_and_truncation(spark):
    assert value(spark, text.token_count(lit(" a\tb \n c "))) == 3
    assert value(spark, text.token_count(lit(None).cast("string"))) == 0
    assert value(spark, text.hard_truncate(lit(" a  b "), 2)) == " a  b "
    assert value(spark, text.hard_truncate(lit(" a  b c"), 2)) == "a b"


def test_flatten_context_stops_at_the_shorter_array(spark):
    titles = F.array(lit("T1"), lit("T2"), lit("T3"))
    sentences = F.array(F.array(lit("a."), lit("b.")), F.array(lit("c.")))
    assert value(spark, text.flatten_context(titles, sentences)) == "T1: a. b.\n\nT2: c.\n\n"


def test_first_or_empty(spark):
    assert value(spark, text.first_or_empty(F.array(lit("x"), lit("y")))) == "x"
    assert value(spark, text.first_or_empty(F.expr("cast(array() as array<string>)"))) == ""


@pytest.mark.parametrize(
    "prediction, gold, expected",
    [
        ("it is 42", "42", 1.0),
        ("5", "5.0", 0.0),
        ("7.", "7", 0.0),
        ("Paris!", "paris", 1.0),
        ("Paris", "London", 0.0),
        ("", "x", 0.0),
        ("x", "", 0.0),
        (None, "x", 0.0),
        ("none", "7", 0.0),
        ("1,000", "1000", 1.0),
    ],
)
def test_exact_match(spark, prediction, gold, expected):
    got = metrics.exact_match(lit(prediction).cast("string"), lit(gold))
    assert value(spark, got) == expected


def test_exact_match_by_value(spark):
    assert value(spark, metrics.exact_match(lit("5"), lit("5.0"), numeric=True)) == 1.0


@pytest.mark.parametrize(
    "prediction, gold, expected",
    [
        ("the tower in Paris", "Paris", 1.0),
        ("x", "the of", 0.0),
        ("tower", "Eiffel Tower", 0.0),
        ("Tower, eiffel", "the Eiffel Tower tower", 1.0),
        ("", "x", 0.0),
        ("...", "x", 0.0),
        ("x", "...", 0.0),
    ],
)
def test_keyword_match(spark, prediction, gold, expected):
    assert value(spark, metrics.keyword_match(lit(prediction), lit(gold))) == expected


def test_stop_words():
    assert len(metrics.STOPWORDS) == len(set(metrics.STOPWORDS)) == 153


def test_entailment_support(spark):
    logits = F.array(lit(0.0), lit(0.0), lit(0.0))
    assert value(spark, metrics.entailment_support(lit("p"), lit("h"), logits)) == pytest.approx(1 / 3)
    assert value(spark, metrics.entailment_support(lit(""), lit("h"), logits)) == 0.0
    assert value(spark, metrics.entailment_support(lit("p"), lit(""), logits)) == 0.0
    none = lit(None).cast("array<double>")
    assert value(spark, metrics.entailment_support(lit("p"), lit("h"), none)) == 0.0
    huge = F.array(lit(0.0), lit(0.0), lit(1000.0))
    assert value(spark, metrics.entailment_support(lit("p"), lit("h"), huge)) == 1.0


def test_hallucination_is_strict(spark):
    assert value(spark, metrics.hallucination(lit(0.5))) == 0.0
    assert value(spark, metrics.hallucination(lit(0.49))) == 1.0


@pytest.mark.parametrize(
    "raw, as_int, as_float",
    [
        ("1.9", 1, 1.9),
        ("-1.9", -1, -1.9),
        (" 2 ", 2, 2.0),
        ("1_000", 1000, 1000.0),
        ("1e2", 100, 100.0),
        (".5", 0, 0.5),
        ("abc", 0, 0.0),
        ("1d", 0, 0.0),
        ("", 0, 0.0),
        (None, 0, 0.0),
        ("inf", 0, 0.0),
        ("1e999", 0, 0.0),
        ("nan", 0, 0.0),
    ],
)
def test_lenient_casts(spark, raw, as_int, as_float):
    column = lit(raw).cast("string")
    assert value(spark, casts.lenient_int(column)) == as_int
    assert value(spark, casts.lenient_float(column)) == as_float


def test_numeric_and_timestamp(spark):
    assert value(spark, casts.numeric(lit("x"))) is None
    assert value(spark, casts.numeric(lit("nan"))) is None
    assert value(spark, casts.numeric(lit("2.5"))) == 2.5
    for good in ("2024-01-02T03:04:05", "2024-01-02T03:04:05.678901", "2024-01-02 03:04:05"):
        assert value(spark, casts.timestamp(lit(good))) is not None
    assert value(spark, casts.timestamp(lit("soon"))) is None


def test_build_prompt(spark):
    with_context = value(spark, prompts.build_prompt(lit("C"), lit("Q")))
    assert with_context == "Context:\nC\n\nQuestion: Q" + PROMPT_TAIL
    for blank in ("", "  \n", None):
        assert value(spark, prompts.build_prompt(lit(blank).cast("string"), lit("Q"))) == "Question: Q" + PROMPT_TAIL
    assert PROMPT_TAIL.endswith("\nAnswer:")


@pytest.mark.parametrize("window, cap", [(4096, 4024), (None, 4024), (200_000, 4024), (0, 4024), (70, 1), (2048, 1976)])
def test_input_cap(spark, window, cap):
    assert value(spark, prompts.input_cap(lit(window).cast("int"), lit(None).cast("int"))) == cap


def test_fit_to_window(spark):
    fitted = value(spark, prompts.fit_to_window(lit("a b c"), lit(2)))
    assert tuple(fitted) == ("a b", 2, True)
    fitted = value(spark, prompts.fit_to_window(lit("a b c"), lit(3)))
    assert tuple(fitted) == ("a b c", 3, True)
    fitted = value(spark, prompts.fit_to_window(lit("a b c"), lit(4)))
    assert tuple(fitted) == ("a b c", 3, False)


def test_premise(spark):
    small = Settings(premise_tokens=2)
    assert value(spark, prompts.premise(lit(" "), lit("p q r"), small)) == "p q"
    assert value(spark, prompts.premise(lit("c"), lit("p q r"), small)) == "c"


def test_compression_decision(spark):
    def decide(tokens, settings, available=True):
        return tuple(
            value(spark, prompts.compression_decision(lit("long"), lit(tokens), lit("s"), lit(1), available, settings))
        )

    relaxed = Settings(force_compression=False, compression_threshold=5)
    assert decide(5, relaxed) == ("long", 5, 5, False)
    assert decide(6, relaxed) == ("s", 6, 1, True)
    assert decide(5, Settings(compression_threshold=5)) == ("s", 5, 1, True)
    assert decide(6, relaxed, available=False) == ("long", 0, 0, False)


@pytest.mark.parametrize(
    "name, family",
    [
        ("TinyLlama/TinyLlama-1.1B", "Tiny"),
        ("dolphin", "Phi"),
        ("meta-llama/Llama-2-7b", "LLaMA2"),
        ("Mistral-7B", "Mistral"),
        ("Meta-Llama-3-8B", "LLaMA3"),
        ("other", "other"),
    ],
)
def test_model_family(spark, name, family):
    assert value(spark, metrics.model_family(lit(name))) == family


@pytest.mark.parametrize("mode, label", [(1.0, "compressed"), (1.5, "compressed"), (0.0, "uncompressed"), (2.0, "uncompressed"), (-1.0, "uncompressed")])
def test_compression_label(spark, mode, label):
    assert value(spark, metrics.compression_label(lit(mode))) == label


def test_errors(spark):
    assert value(spark, metrics.is_out_of_memory(lit("CUDA Out Of Memory. Tried"))) is True
    assert value(spark, metrics.is_out_of_memory(lit("CUBLAS_STATUS_ALLOC_FAILED"))) is True
    assert value(spark, metrics.is_out_of_memory(lit("disk full"))) is False
    assert value(spark, metrics.is_out_of_memory(lit(None).cast("string"))) is False
    made = value(spark, metrics.error_text(lit("ValueError"), lit("x" * 500)))
    assert made == "[SKIPPED_ERROR] ValueError: " + "x" * 180
    assert value(spark, metrics.is_error(lit(made))) is True
    assert value(spark, metrics.is_error(lit("fine"))) is False


def test_response_consistency(spark):
    none = F.expr("cast(array() as array<array<float>>)")
    assert value(spark, vectors.response_consistency(none)) == 0.0
    one = F.array(F.array(lit(1.0), lit(2.0)))
    assert value(spark, vectors.response_consistency(one)) == 1.0
    same = F.array(F.array(lit(1.0), lit(0.0)), F.array(lit(3.0), lit(0.0)))
    assert value(spark, vectors.response_consistency(same)) == pytest.approx(1.0)
    square = F.array(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(2.0)))
    assert value(spark, vectors.response_consistency(square)) == pytest.approx(0.0)
    zero = F.array(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))
    assert value(spark, vectors.response_consistency(zero)) == pytest.approx(-0.5)


def test_text_functions_agree_with_python_on_mixed_unicode(spark):
    """Random texts of all white space, all ASCII punctuation, digits of several scripts and letters."""
    import random
    import re
    import string

    draw = random.Random(7)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    alphabet = spaces + list(string.punctuation) + list("0123٤५7９") + list("aZéÉñßж“”—x") + [".", "-", ",", "#"] * 8
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = df.select(
        "i", text.normalize_text(t).alias("n"), text.last_number(t).alias("d"), text.strip(t).alias("s"),
        text.tokens(t).alias("w"), text.final_answer(t).alias("f"), text.is_blank(t).alias("b"),
    )
    for r in got.collect():
        raw = texts[r.i]
        kept = "".join(ch for ch in raw.lower() if ch not in string.punctuation)
        assert r.n == " ".join(kept.split())
        numbers = list(re.finditer(r"-?\d+\.?\d*", "".join(raw.split(","))))
        assert r.d == (numbers[-1].group() if numbers else None)
        assert r.s == raw.strip() and r.w == raw.split()
        assert r.f == raw.rsplit("####", 1)[-1].strip() or "#####" in raw
        assert r.b == (not raw.strip())
