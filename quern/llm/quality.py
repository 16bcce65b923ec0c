"""Quality rules: divergence of a document's histograms from its language, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, spare, staged

SYMBOLS = "[#*$%&|<>]"
#: A word is common if it makes up at least this many thousandths of its language's words. By that
#: share a language has 333 common words at most, however many words it has.
COMMON_PERMILLE = 3
#: Words that a language needs for a reference of its own.
LANGUAGE_WORDS = 5000
CLASSES = ("upper", "digits", "symbols", "spaces", "marks", "others")
PATTERNS = {"upper": r"\p{Lu}", "digits": r"\p{Nd}", "symbols": SYMBOLS, "marks": r"[\p{P}\p{S}&&[^#*$%&|<>]]"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash. Only where some repeat are they sorted, with their places,
    and each place of a run of equals counts the words that no earlier place has counted.
    """

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda p: F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).cast("long").alias("n")), lambda a: a["n"])

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def measures(text: Column) -> Column:
    """A struct of counts over a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def classes(text: Column, measured: Column) -> Column:
    """Characters of each of CLASSES, as an array."""
    upper, digits, marks = (F.regexp_count(text, F.lit(PATTERNS[x])).cast("long") for x in ("upper", "digits", "marks"))
    letters = measured["word_chars"] - measured["n_symbols"]
    return F.array(upper, digits, measured["n_symbols"], F.char_length(text) - measured["word_chars"], marks, letters - upper - digits - marks)


def runs_of(letters: Column) -> Column:
    """A pattern of whole runs of letters that match `letters`."""
    return F.concat(F.lit(r"(?<!\p{L})(?:"), letters, F.lit(r")(?!\p{L})"))


def tokens(documents: DataFrame) -> DataFrame:
    """(lang, token, n): every word of every document, counted by language in one pass over the texts.
    A token of a blank and a number counts the documents with so many characters between words."""
    text = F.coalesce("text", F.lit(""))
    gap = lambda w: F.concat(F.lit(" "), (F.char_length(text) - F.char_length(F.array_join(w, ""))).cast("string"))
    found = documents.select("lang", F.explode(let(words_of(text), lambda w: F.concat(w, F.array(gap(w))))).alias("token"))
    return found.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def references(documents: DataFrame) -> DataFrame:
    """A row for each language of LANGUAGE_WORDS words or more, and one of null language for all
    documents together: lang, the common words and their shares, the shares of the character classes,
    and a pattern of the words. All words of all documents count, whatever their length; a word is a
    run of letters in lower case. Classes and runs are taken from the distinct tokens, each once."""
    counted = staged(tokens(documents), "quality-tokens")
    is_word = ~F.col("token").startswith(" ")
    of = {x: F.regexp_count("token", F.lit(p)) for x, p in PATTERNS.items()}
    of |= {"others": F.char_length("token") - sum(of.values()), "n_words": F.lit(1)}
    sums = [F.sum(F.when(is_word, F.col("n") * v).otherwise(F.lit(0))).alias(x) for x, v in of.items()]
    sums.append(F.sum(F.when(~is_word, F.col("n") * F.expr("substring(token, 2)").cast("long")).otherwise(F.lit(0))).alias("spaces"))
    totals = staged(counted.groupBy("lang").agg(*sums), "quality-totals")
    pooled = totals.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n_words", *CLASSES)))
    own = totals.where((F.col("n_words") >= LANGUAGE_WORDS) & F.col("lang").isNotNull())
    sized = own.select("lang", "n_words", *CLASSES).union(pooled.select(F.lit(None).cast("string"), "n_words", *CLASSES))
    spoken = counted.where(is_word).select("lang", "n", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    spoken = spoken.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    known = spoken.join(own.select("lang", F.lit(True).alias("own")), "lang", "left")
    both = known.select(F.explode(F.when(F.col("own"), F.array("lang", F.lit(None))).otherwise(F.array(F.lit(None).cast("string")))).alias("ref"), "word", "n").groupBy("ref", "word").agg(F.sum("n").alias("n"))
    common = both.join(sized.select("lang", "n_words"), F.col("ref").eqNullSafe(F.col("lang"))).where(1000 * F.col("n") >= COMMON_PERMILLE * F.col("n_words"))
    listed = common.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word", (F.col("n") / F.col("n_words")).alias("share")))).alias("top"))
    chars = sum(F.col(x) for x in CLASSES)
    joined = sized.join(listed, F.col("ref").eqNullSafe(F.col("lang")), "left").withColumn("top", F.coalesce("top", F.array()))
    words = F.transform("top", lambda x: x["word"])
    shares = F.array(*(F.when(chars > 0, F.col(x) / chars).otherwise(F.lit(0.0)) for x in CLASSES))
    pattern = runs_of(F.when(F.size("top") > 0, F.array_join(words, "|")).otherwise(F.lit("(?!)")))
    return staged(joined.select("lang", words.alias("words"), F.transform("top", lambda x: x["share"]).alias("shares"), shares.alias("classes"), pattern.alias("pattern")), "quality-references")


def divergence(p: Column, q: Column) -> Column:
    """One outcome's part of the Jensen-Shannon divergence in bits."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    return (part(p, q) + part(q, p)) / 2


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, from 0 to 1, of two arrays of shares; what they lack of 1 is one outcome more."""
    rest = divergence(F.greatest(F.lit(0.0), 1 - total(p)), F.greatest(F.lit(0.0), 1 - total(q)))
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, divergence)) + rest))


def judged(documents: DataFrame, class_limit: float = 0.30, word_limit: float = 0.35, class_chars: int = 200, common_words: int = 50) -> DataFrame:
    """documents and a struct _quality: the measures, base_failed, class_distance, word_distance, kept.

    A document is dropped if it fails the base rule (under 50 words, or over half of its words in
    repeated windows), if its character classes lie further than class_limit from those of its
    language and it has class_chars characters, or if its common words lie further than word_limit
    and it has common_words words. Shorter texts get no distance (null) and are not dropped for it. A
    null language, and one of fewer than LANGUAGE_WORDS words, is compared with all documents
    together. Null and empty texts have no words and fail. Every row is judged alone: repeated rows,
    ties and null ids change nothing; an empty table gives an empty one; an input column named
    _quality is replaced, any other name is kept. Languages may be any number: their references are
    joined, and broadcast only if the session's threshold has room for the table's measured size.
    """
    refs = references(documents)
    names = dict(zip(("lang", "words", "shares", "classes", "pattern"), spare(documents, *"abcde"), strict=True))
    measured, shape_, spoken_ = spare(documents, "measured", "shape", "spoken")
    own = refs.where(F.col("lang").isNotNull()).select(*(F.col(k).alias(v) for k, v in names.items()))
    pooled = refs.where(F.col("lang").isNull()).first()
    text = F.coalesce("text", F.lit(""))
    joined = documents.join(own, F.col("lang") == F.col(names["lang"]), "left").withColumn(measured, measures(F.col("text")))
    parts = {k: F.coalesce(names[k], F.array(*map(F.lit, pooled[k])).cast(kind)) for k, kind in (("words", "array<string>"), ("shares", "array<double>"), ("classes", "array<double>"))}
    pattern = F.coalesce(names["pattern"], F.lit(pooled["pattern"]))
    m = F.col(measured)
    n_chars = F.char_length(text)
    shape = let(F.transform(classes(text, m), lambda x: x / n_chars), lambda p: distance(p, parts["classes"]))
    share = lambda found: F.transform(parts["words"], lambda w: (F.size(found) - F.size(F.array_remove(found, w))) / m["n_words"])
    spoken = let(let(F.regexp_extract_all(F.lower(text), pattern, F.lit(0)), share), lambda p: distance(p, parts["shares"]))
    bad = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    with_distances = joined.withColumns({shape_: F.when(n_chars >= class_chars, shape), spoken_: F.when(m["n_words"] >= common_words, spoken)})
    far = F.coalesce(F.col(shape_) > class_limit, F.lit(False)) | F.coalesce(F.col(spoken_) > word_limit, F.lit(False))
    fields = [m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    quality = F.struct(*fields, bad.alias("base_failed"), F.col(shape_).alias("class_distance"), F.col(spoken_).alias("word_distance"), (~bad & ~far).alias("kept"))
    return with_distances.withColumn("_quality", quality).drop(*names.values(), measured, shape_, spoken_)


def accepted(documents: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, under limits of judged, with their own columns. The verdict passes
    through a generator, since a filter on it would otherwise move below the projections and compute
    what they share again and again: use this form, not a filter on judged."""
    kept, verdict = spare(documents, "kept", "verdict")
    held = documents.withColumnRenamed("_quality", verdict) if "_quality" in documents.columns else documents
    marked = judged(held, **limits).withColumn(kept, F.explode(F.array("_quality.kept")))
    chosen = marked.where(kept).drop(kept, "_quality")
    return chosen.withColumnRenamed(verdict, "_quality") if held is not documents else chosen


def verdicts(documents: DataFrame) -> DataFrame:
    return judged(documents.select("doc_id", "text", "lang")).select("doc_id", "_quality.*")
