r"""Fill-in-middle transformation: each text is cut at two unit boundaries and its middle moved to the end.

A unit grammar says between which neighbouring classes of characters a unit ends. It is translated to
one zero-width regular expression, a lookbehind for the class before and a lookahead for the class
after, so that Spark's `split` cuts there and loses no character. Java's `split` has no empty first
piece for a zero-width match, but gives one empty piece for an empty text, which has no units; empty
texts are therefore handled apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY, _SPACE, _INK, _LETTER, _DIGIT = "(?s:.)", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"(?:\p{L}|\p{M})", r"\p{Nd}"
_OTHER = f"(?!{_LETTER}|{_DIGIT}|{_SPACE}){_ANY}"
#: A unit ends wherever some pair of neighbours fits: (what stands before, what comes after), as regular expressions of bounded length.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "character": ((_ANY, _ANY),),  # code points
    "word": ((_SPACE, _INK),),  # a word and the white space behind it
    "line": ((r"\n", _ANY), (r"\r", r"[^\n]")),
    "sentence": ((rf"[.!?]{_SPACE}", _INK), (r"[。！？]", _ANY)),
    "paragraph": ((r"\n\n", r"[^\n]"),),
    "run": (*((c, f"(?!{c}){_ANY}") for c in (_LETTER, _DIGIT, _SPACE)), (_OTHER, _ANY)),  # letters, digits, white space, or one other character
}
#: The markers of the parts, and the shares of texts left plain and of transformed ones with the suffix first, in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
_MARKER = "<[PSM]>"


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The zero-width regular expression that fits where a unit ends and another begins."""
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def units(text: Column, unit: str = "character") -> Column:
    """The text's units in order; their concatenation is the text. None for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[unit]), -1))


def draws(key: Column) -> list[Column]:
    """Four numbers below 2**32 from the key's digest."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = "character", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) for every row of docs.

    n is the text's number of units. form is plain, psm or spm; the parts are null and output is the
    text where it is plain: where the text is empty or holds a marker, or by the id's draw. Cuts depend
    on the id and n alone, so reruns agree and rows that repeat an id and a text agree too; a null id
    draws as the empty string, a null text counts as empty. Any of the parts may be empty. Other columns of docs are not
    read, so their names cannot clash; an empty table gives an empty table. A text's units are in
    memory together, about a hundred bytes each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("units", units(F.col("text"), unit)).withColumn("n", F.size("units").cast("long"))
    h = draws(F.col("doc_id"))
    places = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    form = F.when((F.col("text") == "") | F.col("text").rlike(_MARKER) | (h[2] % 100 >= transformed), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.withColumns({"form": form, "a": F.least(*places).cast("int"), "b": F.greatest(*places).cast("int")})
    part = lambda first, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, length), ""))
    cut = cut.withColumns({"prefix": part(F.lit(1), F.col("a")), "middle": part(F.col("a") + 1, F.col("b") - F.col("a")), "suffix": part(F.col("b") + 1, F.size("units") - F.col("b"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() made `output` from; a transformed text holds each marker once."""
    parts = F.split(output, _MARKER, -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of transform()'s rows."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    length = lambda c: F.char_length(c).cast("long")
    return made.select(
        F.col(id_col).alias("doc_id"), "n", "form", length(F.col("prefix")).alias("prefix_chars"), length(F.col("middle")).alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle(table: str) -> str:
    """DuckDB SQL for digests(transform()) by code points over `table`."""
    h = [f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT" for k in range(4)]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM {table}),
c AS (SELECT *, length(text)::BIGINT AS n, {h[0]} % (length(text) + 1) AS x, {h[1]} % (length(text) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {h[2]} % 100 >= {TRANSFORMED} THEN 'plain'
    WHEN {h[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, substr(text, 1, least(x, y)) AS pre, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(text, greatest(x, y) + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
