"""Text, hash and vector expressions over columns.

White space and case are Python's, as far as they go beyond Latin-1 by an Arrow function that only
the rows with such characters are sent to; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: A word, a part of an identifier, an identifier, a run of Han characters, white space.
TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[a-z0-9]+(?:[-_.][a-z0-9]+)+|[a-z]+\d+[a-z0-9-]*"
HAN = "[㐀-鿿]+"
WHITE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: What marks a credential, and what stays of it.
SECRETS = [r"(?i)(api[_-]?key\s*[=:]\s*)[^\s,;]+", r"(?i)(authorization\s*[=:]\s*bearer\s+)[^\s,;]+"]
REDACTED = "$1[REDACTED]"

_NAMED = r"[a-z0-9][-_.][a-z0-9]|[a-z]\d"  # an identifier has one of these
_LATIN = r"^[\x00-\xB4\xB6-\xFF]*$"  # lower case and ss for sharp s are its whole case folding
_SIMPLE = r"^[\x00-\x7F¡-§©«¬®°±¶·»¿-ÿ–—‘’“”„]*$"  # and these have no compatibility forms


@F.pandas_udf(StringType())
def _casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x.casefold(), na_action="ignore")


def _value(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return "".join(" " if unicodedata.category(c) in ("Mn", "Mc", "Me") else c for c in folded)


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def _values(text: pd.Series) -> pd.Series:
    return text.map(_value, na_action="ignore")


@F.pandas_udf(StringType())
def _bared(text: pd.Series) -> pd.Series:
    return text.map(_bare, na_action="ignore")


def _unless(simple: Column, quick: Column, text: Column, exact) -> Column:
    return F.when(simple, quick).otherwise(exact(F.when(~simple, text)))


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WHITE}+", " "))


def casefold(text: Column) -> Column:
    return _unless(text.rlike(_LATIN), _lower(text), text, _casefolded)


def content_key(text: Column) -> Column:
    """Case and white space aside, the same text gives the same key."""
    return casefold(squeezed(text))


def bare_key(text: Column) -> Column:
    """As ``content_key``, with all white space gone."""
    return casefold(F.regexp_replace(text, WHITE, ""))


def search_value(text: Column) -> Column:
    """Compatibility forms composed and case folded: what words and identifiers are taken from."""
    return _unless(text.rlike(_SIMPLE), _lower(text), text, _values)


def without_marks(value: Column) -> Column:
    """Letters of a search value without their diacritics."""
    return _unless(value.rlike(_SIMPLE), F.translate(value, MARKED, PLAIN), value, _bared)


def grams(run: Column, size: int) -> Column:
    n = F.length(run)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.substring(run, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def han_grams(text: Column) -> Column:
    """One- and two-character grams of each run of U+3400 to U+9FFF."""
    runs = F.regexp_extract_all(text, F.lit(HAN), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2))))


def tokens_of(value: Column, bare: Column) -> Column:
    """The tokens that a text is indexed under, in order: its words, its identifiers' parts twice more, Han grams."""
    names = F.regexp_extract_all(value, F.lit(IDENTIFIER), F.lit(0))
    part = F.regexp_extract_all(F.array_join(names, " "), F.lit(TOKEN), F.lit(0))
    none = F.array().cast("array<string>")
    more = F.when(value.rlike(_NAMED), F.flatten(F.array_repeat(part, 2))).otherwise(none)
    han = F.when(value.rlike(HAN), han_grams(value)).otherwise(none)
    return F.concat(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)), more, han)


def is_simple(text: Column) -> Column:
    """Whether a text's tokens can be had without leaving the JVM (see ``simple_tokens``)."""
    return text.rlike(_SIMPLE)


def simple_key(text: Column) -> Column:
    """``content_key`` of texts that are simple."""
    return _lower(F.btrim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " ")))


def simple_tokens(text: Column) -> Column:
    """``search_tokens`` of texts that are simple."""
    low = _lower(text)
    return tokens_of(low, F.translate(low, MARKED, PLAIN))


def terms_of(value: Column) -> Column:
    """The distinct terms that a question asks for, marks kept: words, whole identifiers, their parts, Han grams."""
    names = F.regexp_extract_all(value, F.lit(IDENTIFIER), F.lit(0))
    part = F.regexp_extract_all(F.regexp_replace(F.array_join(names, " "), "_", " "), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.concat(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), names, part, han_grams(value)))


def phrase_of(term: Column) -> Column:
    """The tokens of a term, which match side by side only."""
    return F.regexp_extract_all(without_marks(term), F.lit(TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    value = search_value(text)
    return tokens_of(value, without_marks(value))


def redacted(text: Column) -> Column:
    for secret in SECRETS:
        text = F.regexp_replace(text, secret, REDACTED)
    return text


def stable_id(*parts: Column, length: int = 32, prefix: str = "") -> Column:
    """A prefix of the SHA-256 of the parts, joined by the unit separator; nulls count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def windows(text: Column, width: int, overlap: int) -> Column:
    """Fixed-width pieces with overlap; the last may be an overlapping tail. One pass over the text.

    The text is cut into steps; a piece is its step and the begin of what follows.
    """
    step = width - overlap
    if step <= 0:
        raise ValueError("the overlap must be below the width")
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    reach = -(-overlap // step)  # steps that an overlap may need
    follows = lambda cut, i: F.left(F.array_join(F.slice(cut, i + 2, reach), ""), F.lit(overlap))
    return F.element_at(F.transform(F.array(steps), lambda cut: F.transform(cut, lambda x, i: F.concat(x, follows(cut, i)))), 1)


def backoff(attempt: Column) -> Column:
    return F.least(F.lit(0.2), F.lit(0.05) * F.pow(F.lit(2.0), attempt))


def bounding_box(points: Column) -> Column:
    """(x0, y0, x1, y1) of an array of (x, y); null where there are none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(points) > 0, box)


def box_of(json: Column) -> Column:
    """(x0, y0, x1, y1) of JSON: an object of l, t, r, b or x0, y0, x1, y1, or a list of four; else null."""
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    named = F.from_json(json, "l double, t double, r double, b double, x0 double, y0 double, x1 double, y1 double")
    listed = F.from_json(json, "array<double>")

    def whole(*cells) -> Column:
        made = F.struct(*[c.alias(n) for c, n in zip(cells, ("x0", "y0", "x1", "y1"))]).cast(kind)
        known = cells[0].isNotNull() & cells[1].isNotNull() & cells[2].isNotNull() & cells[3].isNotNull()
        return F.when(known, made)

    return F.coalesce(
        whole(named["l"], named["t"], named["r"], named["b"]), F.when(named["l"].isNull(), whole(named["x0"], named["y0"], named["x1"], named["y1"])),
        F.when(F.size(listed) == 4, whole(*[F.get(listed, i) for i in range(4)])),
    )
