"""Column expressions over text: white space, lines, words, cases, slugs, cleaning, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it: ASCII, no-break, byte order mark, line separators, all Zs.
SPACE = r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]"
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
LINE_END = r"\r\n|\r|\n"

# Word lists and code points whose members decide results.
STOP_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my "
    "one all would there their what so up out if about who get which go me is was are been has had were can said use its our am no"
).split()
SLUG_STOP_WORDS = "a an the and or but of in on at to for with is are was were be by from as that this".split()
MINOR_WORDS = "a an and as at but by for from in into nor of off on onto or over per so the to up via vs with yet".split()
INVISIBLE = {
    0x0009: "Tab",
    0x00A0: "Non-breaking space",
    0x200B: "Zero-width space",
    0x200C: "Zero-width non-joiner",
    0x200D: "Zero-width joiner",
    0x200E: "Left-to-right mark",
    0x200F: "Right-to-left mark",
    0x2028: "Line separator",
    0x2029: "Paragraph separator",
    0x202F: "Narrow no-break space",
    0x2060: "Word joiner",
    0x00AD: "Soft hyphen",
    0x3000: "Ideographic space",
    0xFEFF: "Byte order mark",
}
ZERO_WIDTH = "​‌‍⁠﻿­‎‏"
SPACE_LIKE = "               　"


#: The same characters one by one.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u2028\u2029\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Trim white space in the wide sense; trim() strips U+0020 only."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\s\x{{A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}\p{{Zs}}]")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it; a lambda's body is evaluated anew at each mention."""
    return F.get(F.transform(F.array(c), f), 0)


def half_up(c: Column, places: int = 0) -> Column:
    """Round half towards plus infinity; round() rounds half away from zero."""
    f = float(10**places)
    return F.floor(c * F.lit(f) + F.lit(0.5)) / F.lit(f)


def word_summary(c: Column) -> Column:
    """n and longest of a text's words; a column of its own, so that they are split once a text."""
    longest = lambda found: F.aggregate(found, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return bound(words(c), lambda found: F.struct(F.size(found).alias("n"), longest(found).alias("longest")))


def text_counts(c: Column, summary: Column) -> dict[str, Column]:
    """Characters are code points; a hyphenated compound is one word. summary: word_summary(c)."""
    filled = ~is_blank(c)
    n, longest = summary["n"], summary["longest"]
    paragraphs = F.size(F.filter(F.split(c, rf"\n{SPACE}*\n", -1), lambda p: ~is_blank(p)))
    return {
        "characters": F.length(c),
        "characters_no_spaces": F.length(F.regexp_replace(c, SPACE, "")),
        "n_words": n,
        "sentences_loose": F.when(filled, F.regexp_count(c, F.lit("[^.!?…。！？]+[.!?…。！？]*"))).otherwise(0),
        "paragraphs": F.when(filled, paragraphs).otherwise(0),
        "n_lines": F.when(c == "", 0).otherwise(F.size(lines(c))),
        "reading_seconds": F.floor(n / F.lit(238.0) * 60 + 0.5).cast("int"),
        "speaking_seconds": F.floor(n / F.lit(150.0) * 60 + 0.5).cast("int"),
        "longest_word": longest,
    }


def syllables(w: Column) -> Column:
    """Of a word in lower case that holds a-z only."""
    body = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(body, F.lit("[aeiouy]{1,2}"))))


def ease_label(c: Column) -> Column:
    bands = ((90, "Very easy — 5th grade"), (80, "Easy — 6th grade"), (70, "Fairly easy — 7th grade"), (60, "Plain English — 8th–9th grade"), (50, "Fairly difficult — 10th–12th grade"), (30, "Difficult — university"))
    out = F.lit("Very difficult — postgraduate")
    for least, label in reversed(bands):
        out = F.when(c >= least, label).otherwise(out)
    return out


def readability_counts(c: Column) -> Column:
    """What readability() needs, as a struct; a column of its own, so that words are split once a text."""

    def counted(found: Column) -> Column:
        each = lambda e: F.struct(F.size(e).cast("double").alias("n"), F.aggregate(e, F.lit(0), lambda a, x: a + x).alias("syllables"), F.size(F.filter(e, lambda x: x >= 3)).alias("hard"))
        bare = F.array(F.transform(found, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")))
        return F.get(F.transform(F.get(F.transform(bare, lambda b: F.array(F.transform(b, syllables))), 0), each), 0)

    found = F.filter(words(c), lambda w: w.rlike("[a-zA-Z]"))
    ends = F.regexp_count(c, F.lit("[^.!?…][.!?…]+"))  # what precedes an end needn't be matched, which would take the square of an endless sentence
    sentences = F.greatest(F.lit(1), ends)
    return F.struct(F.get(F.transform(F.array(found), counted), 0).alias("w"), sentences.alias("sentences"))


def readability(counts: Column) -> dict[str, Column]:
    """Flesch ease and grade, Fog, of readability_counts(); sentences need a terminator, one at least."""
    n, total, hard = counts["w"]["n"], counts["w"]["syllables"], counts["w"]["hard"]
    wps, spw = n / counts["sentences"], total / F.nullif(n, F.lit(0.0))
    ease = 206.835 - 1.015 * wps - 84.6 * spw
    some = n > 0
    or_zero = lambda x: F.when(some, x).otherwise(0.0)
    return {
        "ease": or_zero(half_up(ease, 1)),
        "grade": or_zero(half_up(0.39 * wps + 11.8 * spw - 15.59, 1)),
        "fog": or_zero(half_up(0.4 * (wps + 100 * (hard / F.nullif(n, F.lit(0.0)))), 1)),
        "syllables": total,
        "complex_words": hard,
        "ease_label": F.when(some, ease_label(ease)).otherwise("No text"),
    }


def tokens(c: Column) -> Column:
    """Words of an identifier or phrase: split at case changes, white space, _ - and dots."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}_\-.]+", -1), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))


def programmer_case(c: Column, mode: str) -> Column:
    t = tokens(c)
    if mode == "pascal":
        return F.array_join(F.transform(t, capital), "")
    if mode == "camel":
        return F.array_join(F.transform(t, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(w))), "")
    sep = {"snake": "_", "kebab": "-", "constant": "_", "dot": "."}[mode]
    return F.array_join(F.transform(t, F.upper if mode == "constant" else F.lower), sep)


def title_case(c: Column) -> Column:
    """Per line: first and last word capital, minor words lower, other words capital."""

    def titled(pieces: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            inner = (i > 1) & (i < F.size(pieces) - 2)  # words and blanks take turns, so these are neither first nor last
            minor = F.regexp_replace(F.lower(w), "[^a-z]", "").isin(MINOR_WORDS)
            return F.when(w.rlike(r"^\s"), w).when(inner & minor, F.lower(w)).otherwise(capital(w))

        return F.array_join(F.transform(pieces, word), "")

    pieces = F.transform(F.split(c, "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(r"\s+|\S+"), 0))
    return F.array_join(F.transform(pieces, titled), "\n")


def toggle_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "", -1), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def _latin_map() -> tuple[str, str]:
    """Letters and their ASCII base, of all that decompose into one and marks of U+0300 to U+036F."""
    import unicodedata

    def base(x: str) -> str:
        d = unicodedata.normalize("NFD", x)
        return d[0] if d != x and d[0].isascii() and all(0x300 <= ord(m) <= 0x36F for m in d[1:]) else ""

    pairs = [(chr(i), b) for i in range(0xC0, 0x3000) if (b := base(chr(i)))]
    pairs += [("đ", "d"), ("Đ", "d"), ("ø", "o"), ("Ø", "o")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slugify(c: Column, separator: str = "-", stop_words: bool = False, max_length: int = 60) -> Column:
    plain = F.translate(F.regexp_replace(c, r"[\x{300}-\x{36F}]", ""), *_latin_map())
    plain = F.lower(F.regexp_replace(F.regexp_replace(plain, "[ßẞ]", "ss"), "[æÆ]", "ae"))
    found = F.filter(F.split(plain, "[^a-zA-Z0-9]+", -1), lambda w: w != "")
    if stop_words:
        kept = F.filter(found, lambda w: ~w.isin(SLUG_STOP_WORDS))
        found = F.when(F.size(kept) > 0, kept).otherwise(found)
    slug = F.array_join(found, separator)
    cut = F.substring(slug, 1, max_length)
    back = F.regexp_replace(cut, f"^(.+)[{separator}][^{separator}]*$", "$1")
    return F.when(F.length(slug) > max_length, back).otherwise(slug)


def line_ending(c: Column) -> Column:
    crlf = F.regexp_count(c, F.lit("\r\n"))
    lf, cr = F.regexp_count(c, F.lit("\n")) - crlf, F.regexp_count(c, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("cr")


def clean_whitespace(c: Column, *, line_endings=False, zero_width=True, spaces=True, punctuation=False, tab_width=0, collapse=True, trim_lines=True, remove_blank=False, collapse_blank=True) -> Column:
    """The cleaning steps in their fixed order."""
    if line_endings:
        c = F.regexp_replace(c, "\r\n|\r", "\n")
    if zero_width:
        c = F.translate(c, ZERO_WIDTH, "")
    if spaces:
        c = F.translate(c, SPACE_LIKE, " " * len(SPACE_LIKE))
    if punctuation:
        for pattern, to in (("[‘’‚‛]", "'"), ("[“”„‟]", '"'), ("[–—]", "-"), ("…", "..."), (" ", " ")):
            c = F.regexp_replace(c, pattern, to)
    if tab_width:
        c = F.replace(c, F.lit("\t"), F.lit(" " * tab_width))
    if collapse:
        c = F.regexp_replace(c, r"[\t\x0B\f\x{A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]{2,}", " ")
    if trim_lines:
        c = F.array_join(F.transform(F.split(c, "\n", -1), trim), "\n")
    if remove_blank:
        return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_blank(x)), "\n")
    return F.regexp_replace(c, "\n{3,}", "\n\n") if collapse_blank else c


def reveal(c: Column, show_spaces: bool = False) -> Column:
    """Invisible characters made visible."""
    for code in INVISIBLE:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"⟦U+{code:04X}⟧"))
    c = F.replace(F.replace(c, F.lit("\n"), F.lit("¶\n")), F.lit("\r"), F.lit("␍"))
    return F.replace(c, F.lit(" "), F.lit("·")) if show_spaces else c


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_SPACES = r"\s\x{A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}"

# What counts as personal data, in the order of the replacements; \b, \d and \w know ASCII only.
PERSONAL = (
    (r"[\w.+\-]+@[\w\-]+\.[\w.\-]+", "[email]"),
    (rf"\b(?:\+?\d{{1,3}}[{_SPACES}\-]?)?(?:\(\d{{2,4}}\)[{_SPACES}\-]?)?\d{{3,4}}[{_SPACES}\-]?\d{{3,4}}[{_SPACES}\-]?\d{{0,4}}\b", "[phone]"),
    (r"\b(?:\d[ \-]*?){13,19}\b", "[card]"),
)
# Turns of phrase that try to override instructions.
INJECTIONS = (
    rf"(?i)ignore[{_SPACES}]+(all[{_SPACES}]+)?(previous|prior|above)[{_SPACES}]+instructions",
    rf"(?i)disregard[{_SPACES}]+(all[{_SPACES}]+)?(previous|prior|the)[{_SPACES}]+(instructions|rules|system)",
    rf"(?i)you[{_SPACES}]+are[{_SPACES}]+now[{_SPACES}]+(a|an)[{_SPACES}]+",
    rf"(?i)\bsystem[{_SPACES}]*(prompt|message)[{_SPACES}]*[:=]",
    r"(?i)<\|?(im_start|im_end|system|assistant)\|?>",
    rf"(?i)reveal[{_SPACES}]+(your|the)[{_SPACES}]+(system[{_SPACES}]+)?(prompt|instructions)",
)


def ascii_edges(pattern: str) -> str:
    """The pattern with \\b between ASCII word characters and others; Java's own knows Unicode letters."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def mask_pii(c: Column) -> Column:
    return replace_chain(c, [(ascii_edges(p), to) for p, to in PERSONAL])


def guard_input(c: Column, most: int = 12_000) -> Column:
    """The first characters of a text, without overriding phrases, between marks."""
    clean = replace_chain(F.substring(c, 1, most), [(ascii_edges(p), "[removed]") for p in INJECTIONS])
    return F.concat(F.lit("<user_input>\n"), clean, F.lit("\n</user_input>"))


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clamp_words(c: Column, n: int) -> Column:
    """At most n characters, cut at a word, with an ellipsis."""
    cut = F.substring(c, 1, n - 1)
    whole = F.regexp_replace(F.regexp_replace(cut, r" [^ ]*$", ""), r"[\s,;:.\-]+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(whole, F.lit("…")))


def replace_chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Each rule (pattern, replacement) sees what the previous one made."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def numeric_key(c: Column) -> Column:
    """The first number in a line, or null."""
    return F.nullif(F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def natural_key(c: Column, case_sensitive: bool = False, collation: str = "UNICODE") -> Column:
    """A sort key in which digits compare as numbers and letters as in a dictionary: accents near their base, lower case first."""
    parts = F.regexp_extract_all(c if case_sensitive else F.lower(c), F.lit(r"[0-9]+|[^0-9]+"), 0)
    wide = lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, F.greatest(F.length(p), F.lit(20)), F.lit("0"))).otherwise(p)
    return F.collate(F.array_join(F.transform(parts, wide), ""), collation)


def sentence_case(c: Column) -> Column:
    """Lower, with a capital at the start, after a sentence's end and after a line end."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(rf"(?s).*?(?:[.!?…]{SPACE}+|\n|$)"), 0)

    def raised(p: Column) -> Column:
        start = F.regexp_extract(p, rf"^{SPACE}*[A-Za-z0-9_]", 0)
        return F.concat(F.upper(start), F.substring(p, F.length(start) + 1, F.length(p)))

    return F.array_join(F.transform(parts, raised), "")


def alternating_case(c: Column) -> Column:
    """Every other letter is a capital; only letters are counted."""
    pairs = F.regexp_extract_all(c, F.lit(r"(?s)\P{L}*(?:\p{L}\P{L}*){1,2}|\P{L}+"), 0)  # two letters each, with what lies around
    second = rf"(?s)^\P{{L}}*\p{{L}}\P{{L}}*"

    def one(p: Column) -> Column:
        low = F.regexp_extract(p, second, 0)
        return F.when(low == "", p).otherwise(F.concat(F.lower(low), F.upper(F.substring(p, F.length(low) + 1, F.length(p)))))

    return F.array_join(F.transform(pairs, one), "")


def singular(c: Column) -> Column:
    """A plural name's singular, by its ending."""
    short = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    return F.when(c.rlike("(?i)ies$") & (F.length(c) > 4), F.concat(short(3), F.lit("y"))).when(c.rlike("(?i)(s|x|z|ch|sh)es$"), short(2)).when(c.rlike("(?i)[^su]s$"), short(1)).otherwise(c)


def type_name(c: Column) -> Column:
    """A name for a type: words joined, their first letters capital; Type where nothing is left."""
    parts = F.split(trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), r"\s+|(?<=[a-z0-9])(?=[A-Z])", -1)
    joined = F.array_join(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")
    return F.when(joined == "", "Type").when(joined.rlike("^[A-Za-z_$]"), joined).otherwise(F.concat(F.lit("Type"), joined))


# The least reading ease for each kind of reader.
TARGETS = {"general": 60, "academic": 30, "marketing": 70}


def strip_bullet(c: Column) -> Column:
    """A line without its bullet or number."""
    return F.regexp_replace(c, r"^\s*(?:[•·▪‣◦●○■□–—*\-»›]|\d{1,2}[.)]|\(\d{1,2}\))\s+", "")
