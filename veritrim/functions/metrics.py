"""Answer metrics and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrim.functions.text import last_number, normalize_text
from veritrim.schemas import ERROR_MARK, OOM_MARKERS, Settings

# English stop words, without contractions (normalised text has no apostrophes).
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will "
    "just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma "
    "mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def _score(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def exact_match(
    prediction: Column,
    gold: Column,
    numeric: bool = False,
    normalized_prediction: Column | None = None,
    normalized_gold: Column | None = None,
) -> Column:
    """1.0 when the last numbers agree as text, or, for gold without a number, the normalised texts.

    ``numeric=True`` compares the numbers by value instead. Normalised texts that are at hand can be passed in.
    """
    if normalized_prediction is None:
        normalized_prediction = normalize_text(prediction)
    if normalized_gold is None:
        normalized_gold = normalize_text(gold)
    wanted, given = last_number(gold), last_number(prediction)
    same_number = (
        (given.try_cast("double") == wanted.try_cast("double")) if numeric else (given == wanted)
    )
    return (
        F.when(_is_empty(prediction) | _is_empty(gold), F.lit(0.0))
        .when(wanted.isNotNull(), _score(same_number))
        .otherwise(_score(normalized_prediction == normalized_gold))
    )


def keyword_match(
    prediction: Column,
    gold: Column,
    normalized_prediction: Column | None = None,
    normalized_gold: Column | None = None,
) -> Column:
    """1.0 when every gold word that is not a stop word occurs in the prediction."""
    if normalized_prediction is None:
        normalized_prediction = normalize_text(prediction)
    if normalized_gold is None:
        normalized_gold = normalize_text(gold)
    ignored = F.array(*[F.lit(word) for word in ["", *STOPWORDS]])
    wanted = F.array_except(F.split(normalized_gold, " "), ignored)
    given = F.split(normalized_prediction, " ")
    # A lambda over a one-element array names the word list, so that it is made once.
    hit = F.transform(F.array(wanted), lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, given)) == 0))
    return F.when(_is_empty(prediction) | _is_empty(gold), F.lit(0.0)).otherwise(_score(F.element_at(hit, 1)))


def softmax(logits: Column) -> Column:
    """Class probabilities, shifted by the largest logit."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def entailment_support(premise: Column, hypothesis: Column, logits: Column, entailment: int = 2) -> Column:
    """Probability of the entailment class; 0.0 for empty text or without a model."""
    support = F.try_element_at(softmax(logits), F.lit(entailment + 1))
    return F.when(_is_empty(premise) | _is_empty(hypothesis), F.lit(0.0)).otherwise(
        F.coalesce(support, F.lit(0.0))
    )


def hallucination(support: Column, settings: Settings = Settings()) -> Column:
    """1.0 when the support is below the threshold."""
    return (support < settings.hallucination_threshold).cast("double")


def is_out_of_memory(message: Column) -> Column:
    text = F.lower(message)
    hit = F.lit(False)
    for marker in OOM_MARKERS:
        hit = hit | F.contains(text, F.lit(marker))
    return F.coalesce(hit, F.lit(False))


def error_text(kind: Column, message: Column, settings: Settings = Settings()) -> Column:
    """Prediction text of a row that failed."""
    return F.concat(
        F.lit(ERROR_MARK), kind, F.lit(": "), F.substring(F.coalesce(message, F.lit("")), 1, settings.error_chars)
    )


def is_error(prediction: Column) -> Column:
    return F.coalesce(F.startswith(prediction, F.lit(ERROR_MARK.strip())), F.lit(False))


def compression_label(compressed: Column) -> Column:
    """``compressed`` for a value that truncates to 1, ``uncompressed`` for every other one."""
    return F.when(compressed.cast("int") == 1, "compressed").otherwise("uncompressed")


def model_family(name: Column) -> Column:
    """Family of a model by the first matching part of its name; the name itself when none matches."""
    text = F.lower(name)
    # Order matters.
    rules = (("tiny", "Tiny"), ("phi", "Phi"), ("llama-2", "LLaMA2"), ("mistral", "Mistral"), ("llama-3", "LLaMA3"))
    family = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, label in rules:
        family = family.when(F.contains(text, F.lit(part)), F.lit(label))
    return family.otherwise(name)


def exact_sum(c: Column) -> Column:
    """Sum of doubles as a double, the same in any order of the rows: of decimals of twelve places.

    Groups with a value beyond the range of the decimals are summed as doubles.
    """
    digits = c.try_cast("decimal(28,12)")
    return F.when(F.count(digits) == F.count(c), F.sum(digits).cast("double")).otherwise(F.sum(c))


def exact_mean(c: Column) -> Column:
    """Mean of the values that are there, the same in any order of the rows; NULL without any."""
    return F.try_divide(exact_sum(c), F.count(c))
