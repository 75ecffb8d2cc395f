"""Text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` alone would take spaces only)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of blanks to one, three or more line feeds to two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if something is cut."""
    return let(strip(blank(c)), lambda s: F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(most - 1)), F.lit(" \t\n\x0b\f\r")), F.lit("…"))))


def tokens(c: Column) -> Column:
    """Lower-case tokens of three or more characters, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(blank(c)), F.lit(r"([a-z0-9][a-z0-9_.\-]*)"), F.lit(1))
    return F.filter(found, lambda t: (F.char_length(t) > 2) & ~t.isin(vocab.STOPWORDS))


def words(c: Column) -> Column:
    """Unicode word tokens, lower case."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def issue_keys(c: Column) -> Column:
    """Distinct issue keys, upper case, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(blank(c)), F.lit(vocab.KEY), F.lit(1)))


def project_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("-")), F.upper(strip(F.split_part(key, F.lit("-"), F.lit(1))))).otherwise(F.lit(""))


def mask_images(c: Column) -> Column:
    return replace_where(c, "!", r"(?i)!\[[^\]]*\]\([^)]*\)|!\[[^\]]*\]|![^!\n]+\.(?:png|jpg|jpeg|gif)[^!\n]*!", " ")


def replace_where(c: Column, sign: str, pattern: str, mark: str) -> Column:
    """The pattern replaced; only texts that hold ``sign``, as every match does, are searched."""
    return let(c, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, mark)).otherwise(x)) if sign else F.regexp_replace(c, pattern, mark)


def mask(c: Column, only: str | None = None) -> Column:
    """Images, mentions, addresses, links, ids and long tokens replaced by marks; ``only`` applies a single mask."""
    out = mask_images(blank(c)) if only is None else blank(c)
    for name, sign, pattern, mark in vocab.MASKS:
        if only in (None, name):
            out = replace_where(out, sign, pattern, mark)
    return collapse(out) if only is None else out


def clean(c: Column, masked: bool = True) -> Column:
    """Without markup noise, masked."""
    out = F.replace(blank(c), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, r"[*_#>`~]{1,3}", " ")
    out = F.regexp_replace(out, r"\[([^\]|]+)\|[^\]]+\]", "$1")
    out = F.regexp_replace(out, r"\{[a-z]+(:[^}]*)?\}", " ")
    return mask(out) if masked else collapse(mask_images(out))


def join_nonempty(parts: list[Column], sep: str) -> Column:
    """The stripped parts that aren't empty, joined."""
    return F.array_join(F.filter(F.array(*[strip(blank(p)) for p in parts]), lambda x: x != ""), sep)


def first_nonempty(*parts: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def error_signature(c: Column) -> Column:
    """Up to six distinct (whatever their case) error phrases, joined by '; '. All begin at a word's edge, so that is asked once, not by every pattern."""
    begun = "|".join(p.removeprefix(r"\b") for p in vocab.ERROR_PATTERNS)
    found = F.transform(F.regexp_extract_all(blank(c), F.lit(rf"(?i)(\b(?:{begun}))"), F.lit(1)), strip)

    def distinct(phrases: Column) -> Column:
        return let(F.transform(phrases, F.lower), lambda low: F.filter(phrases, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    return F.array_join(F.slice(let(found, distinct), 1, 6), "; ")


def first_sentence_with(c: Column, cues: list[str]) -> Column:
    """The first sentence of more than twelve characters that holds a cue, else ''."""
    known = F.array(*map(F.lit, cues))
    has = lambda s: let(F.lower(s), lambda low: F.exists(known, lambda cue: F.contains(low, cue)))
    parts = F.filter(F.transform(F.split(blank(c), r"(?<=[.!?])\s+|\n+"), strip), lambda s: (F.char_length(s) > 12) & has(s))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))


def slug(c: Column, most: int = 80) -> Column:
    out = F.regexp_replace(F.lower(strip(blank(c))), r"[^\p{L}\p{N}_\s\-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(out, r"[\s_\-]+", "_"), "^_+|_+$", ""), F.lit(most))


def section_id(title: Column) -> Column:
    return F.regexp_extract(strip(title), r"^(\d[\d.]*)\s+(.*)", 1)


def section_title(title: Column) -> Column:
    t = strip(title)
    return F.when(t.rlike(r"^\d[\d.]*\s+"), strip(F.regexp_extract(t, r"^(\d[\d.]*)\s+(.*)", 2))).otherwise(t)


def header_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(blank(c))), r"\s+", " ")


def drop_image_links(c: Column) -> Column:
    """Image references give way to their alternative texts."""
    return F.regexp_replace(blank(c), r"!\[([^\]]*)\]\([^)]*\)", "$1")


def last_chars(c: Column, n: int) -> Column:
    return F.when(F.char_length(strip(c)) > n, strip(F.right(strip(c), F.lit(n)))).otherwise(strip(c))


def first_chars(c: Column, n: int) -> Column:
    return F.when(F.char_length(strip(c)) > n, strip(F.left(strip(c), F.lit(n)))).otherwise(strip(c))


def table_cell(c: Column, most: int = 90) -> Column:
    """One line with escaped pipes, at most ``most`` characters, n/a where empty."""
    flat = strip(F.replace(F.replace(blank(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.when(F.char_length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).when(flat == "", "n/a").otherwise(flat)


def normalize_question(c: Column) -> Column:
    """Contractions spelt out, up to three fillers off the front, blanks collapsed, a trailing colon made a question, a capital first."""
    out = strip(blank(c))
    for short, long in vocab.CONTRACTIONS.items():
        if short[0] == "I":  # only as written
            out = F.regexp_replace(out, rf"\b{short}\b", long)
        else:
            out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    filler = "(?i)" + "|".join(vocab.FILLERS)
    for _ in range(3):
        out = strip(F.regexp_replace(out, filler, ""))
    out = strip(F.regexp_replace(out, r"\s{2,}", " "))
    colon = r"(?i)\s*(include[s]?|are|is|consist[s]? of|contain[s]?)?\s*:+\s*$"
    rest = lambda x: F.substring(x, 2, 1 << 30)
    ask = lambda bare: F.when((bare != "") & ~bare.rlike(r"[?]$"), F.concat(F.lit("What are the "), F.lower(F.left(bare, F.lit(1))), rest(bare), F.lit("?"))).otherwise(bare)
    asked = let(out, lambda x: F.when(x.rlike(colon), let(strip(F.regexp_replace(x, colon, "")), ask)).otherwise(x))
    capital = let(asked, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), rest(x)))
    return let(capital, lambda x: F.when(x == "", c).otherwise(x))


def without_no_answer(c: Column) -> Column:
    """Answers that only say the documents have nothing become one plain sentence."""
    body = F.lower(strip(F.regexp_replace(blank(c), r"(?si)\n*-{2,}\s*\n+\s*\*\*Sources:?\*\*.*", "")))
    return F.when(F.exists(F.array(*map(F.lit, vocab.NO_ANSWER_PHRASES)), lambda p: F.contains(body, p)), F.lit(vocab.NO_SOLUTION)).otherwise(c)
