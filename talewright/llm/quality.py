"""Line-first quality cleaning, in DataFrame operations only.

Each line with a word is judged by itself, whatever else its document holds: it must end in sentence punctuation, be
no navigation (two or more separators between items, or three or more words that all start with a capital) and no
boilerplate (stock phrases of web pages and licences in English, French, German and Spanish), be mostly letters, and not shout.
Failing lines go; a document that loses more than a given share of its characters is rejected, as is one that fails the base
rules (too few words, too many words in repeated five-word windows).

Cases: a null or empty text has no words, fails the base and isn't kept; its
cleaned text is empty. Repeated rows are judged each. Lines of white space alone are never counted
and never removed. Columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, quoted, text_of, without

SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;…。！？»”\"')]"
SEPARATORS = r"[|»›·•][^|»›·•]*[|»›·•]| [>/→] .* [>/→] "
CAPITALS = r"^(?:\p{Lu}[^\x20\x09-\x0D]*[\x20\x09-\x0D]+){2,}\p{Lu}[^\x20\x09-\x0D]*$"
BOILERPLATE = (
    r"\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe (?:now|to)|sign (?:in|up)\b|log ?in\b|"
    r"enable javascript|lorem ipsum|powered by|read more|share this|follow us|licensed under|permission is hereby granted|"
    r"tous droits réservés|politique de confidentialité|cliquez ici|lire la suite|conditions d.utilisation|"
    r"alle rechte vorbehalten|datenschutzerklärung|hier klicken|mehr lesen|nutzungsbedingungen|"
    r"todos los derechos reservados|política de (?:privacidad|cookies)|haga clic aquí|leer más|condiciones de uso)"
)
#: CAPITALS without going back, which finds the same: Java's groups that may go back take a stack frame a word, and a stack that
#: overflows ends the executor.
_CAPITALS = CAPITALS.replace("{2,}", "{2,}+")
#: What a line holds if half or more of its characters are no letters: two such in a row, or none but every other one.
FEW_LETTERS = r"[^\p{L}\s]\s*[^\p{L}\s]|^[^\p{L}\s](?:\s*\p{L}\s*[^\p{L}\s])*+$"
#: Share of a document's line characters that its failing lines may hold.
MAX_LOST = 0.5
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost", "clean_text", "kept")


def words_of(text: Column) -> Column:
    """The words. White space becomes blanks first: a split at one character needs no pattern."""
    blank = text
    for c in SPACE.replace(" ", ""):
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blank, " "), "")


def n_spaces(text: Column) -> Column:
    """Characters of white space, counted by length as that is cheaper than a translation."""
    total = F.lit(0)
    for c in SPACE:
        total = total + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return total


def signs_of(text: Column) -> Column:
    """What the whole text holds that rules can't do without; lines are searched only for what is there."""
    return F.struct(
        text.rlike(r"[#*$%&|<>=_~^]").alias("symbols"),
        text.rlike(r"[|»›·•]| [>/→] ").alias("bars"),
        F.lower(text).rlike(BOILERPLATE).alias("canned"),
    )


def judged_lines(text: Column, signs: Column) -> Column:
    """Each line with its size (trimmed characters) and whether it breaks a rule; signs: see signs_of."""
    symbols, bars, canned = (signs[x] for x in ("symbols", "bars", "canned"))
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(SPACE)).alias("trim")))
    rules = lambda x: (
        ~F.contains(F.lit(ENDS), F.substring(x, -1, 1))
        | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) >= 10))
        | F.when(symbols, F.regexp_count(x, F.lit(r"[#*$%&|<>=_~^]")) * 10 > F.length(x)).otherwise(False)
        | F.when(x.rlike(FEW_LETTERS), F.regexp_count(x, F.lit(r"\p{L}")) * 2 < F.length(x) - n_spaces(x)).otherwise(False)
        | F.when(bars, x.rlike(SEPARATORS)).otherwise(False)
        | x.rlike(_CAPITALS)
        | F.when(canned, F.lower(x).rlike(BOILERPLATE)).otherwise(False)
    )
    return F.transform(trimmed, lambda x: F.struct(x["line"].alias("line"), F.length(x["trim"]).alias("size"), F.when(x["trim"] == "", False).otherwise(rules(x["trim"])).alias("fails")))


def base(df: DataFrame, text_col: str) -> DataFrame:
    """df with the base counts; internal columns start with two underscores.

    Repeated windows are looked for only in texts where two windows' hashes are equal:
    there, sorted (window, position) pairs give the positions that repeat, and the covered words
    are counted from the gaps between them.
    """
    out = df.withColumn("__words", words_of(text_of(text_col)))
    out = out.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    hashes = F.col("__hashes")
    # the last four windows are too short: their position makes them differ from all others
    window = lambda x, i: F.when(F.get(hashes, i + 4).isNull(), F.xxhash64(x, i)).otherwise(F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, 5)]))
    out = out.withColumn("__windows", F.transform("__hashes", window))
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs))
    p = F.col("__pairs")
    same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
    again = F.filter(F.transform(p, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda i: i.isNotNull())
    out = out.withColumn("__again", F.sort_array(again))
    a = F.col("__again")
    covered = F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(a, i + 1) - x, F.lit(5)))), F.lit(0), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.when(F.size(a) > 0, covered).otherwise(0).cast("long"))
    return out.drop("__words", "__hashes", "__windows", "__pairs", "__again")


def clean(df: DataFrame, *, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """df with the base counts, lost (share of word characters in failing lines), clean_text and kept."""
    names = [c for c in without(df, *RESULT).columns]
    text = text_of(text_col)
    out = base(without(df, *[r for r in RESULT if r.lower() != text_col.lower()]), text_col)
    # a column of its own that is used four times: the optimizer then doesn't move it into the loop over lines
    out = out.withColumn("__signs", signs_of(text)).withColumn("__lines", judged_lines(text, F.col("__signs")))
    worded = F.transform(F.filter("__lines", lambda x: x["size"] > 0), lambda x: x["line"])
    fine = F.transform(F.filter("__lines", lambda x: ~x["fails"]), lambda x: x["line"])
    sums = F.aggregate("__lines", F.struct(F.lit(0).alias("all"), F.lit(0).alias("bad")), lambda n, x: F.struct((n["all"] + x["size"]).alias("all"), (n["bad"] + F.when(x["fails"], x["size"]).otherwise(0)).alias("bad")))
    out = out.withColumn("__sums", sums)
    out = (
        out.withColumn("word_chars", (F.length(text) - n_spaces(text)).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("__worded", worded)
        .withColumn("n_dup_lines", (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
        .withColumn("clean_text", F.array_join(fine, "\n"))
        .withColumn("lost", F.when(F.col("__sums.all") > 0, F.col("__sums.bad") / F.col("__sums.all")).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    )
    # one row each, through a generator: a filter on its columns isn't pushed into the projections before, where every
    # level of them would be written out again
    return out.select(*[quoted(c) for c in names], F.inline(F.array(F.struct(*RESULT))))
