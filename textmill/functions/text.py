"""String functions on document text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.config import BOLD, CYRILLIC, HAN, HAN_COMPAT, ITALIC, LINE_END, LIST_BULLET, LIST_NUMBER, MARKDOWN_HEADS, MARKDOWN_LABELS, MONO, PUNCTUATION, RESPONSE_LABELS, SANS, SERIF, WS, WS_IN_LINE, Settings, base_language, script_class

#: A character that no text holds; marks matched spans.
MARK = "\ufffe"
PUA = r"\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}"


def _sub(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def java(pattern: str) -> str:
    """A pattern written for Unicode-aware white space and digits, for Java."""
    return pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


#: The characters of ``WS``.
_WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WS_CHARS))


def squash(text: Column) -> Column:
    """All white space deleted."""
    return F.regexp_replace(text, f"{WS}+", "")


def one_line(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def compact_length(text: Column) -> Column:
    return F.length(one_line(text))


def normalize_markers(text: Column, s: Settings = Settings()) -> Column:
    """Leading list markers become one bullet; private-use and NUL characters go; nothing is trimmed."""
    if s.bullet_chars:
        chars = "".join(f"\\x{{{ord(c):x}}}" for c in s.bullet_chars)
        text = F.regexp_replace(text, rf"(?md)(^{WS_IN_LINE}*)[{chars}]", "$1" + re.sub(r"([\\$])", r"\\\1", s.bullet_replace or "•"))
    if s.remove_pua:
        text = F.regexp_replace(text, r"[\x{f000}-\x{f8ff}]", "")
    return F.replace(text, F.lit("\0"), F.lit(""))


_BULLET = r"[•●○▪◆□]|[-–](?=%s|\z)|\p{Nd}+[.)](?=%s|\z)" % (WS, WS)


def soft_wraps(text: Column) -> Column:
    """Joins wrapped lines, keeping paragraphs, separator lines and list items.

    A chain of replacements: lines are trimmed, blank runs become one blank line, separators are
    marked, and a line end goes unless a blank line, a mark or a list item is next to it.
    """
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = _sub(t, (rf"(?md)^{WS_IN_LINE}+|{WS_IN_LINE}+$", ""), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", ""))
    t = F.regexp_replace(t, r"(?md)^([-_=—–]{3,})$", f"{MARK}$1{MARK}")
    kept = rf"[\n{MARK}]"
    t = F.regexp_replace(t, rf"(?<=[{HAN}])\n(?=[{HAN}])", "")
    t = F.regexp_replace(t, rf"(?<!{kept})\n(?!{kept}|{_BULLET})", " ")
    return F.replace(t, F.lit(MARK), F.lit(""))


_ITEM = r"[•\-–—▪]|\(?\p{Nd}+[.)]"


def layout_text(text: Column, s: Settings = Settings()) -> Column:
    """Text for layout: as ``soft_wraps``, with its own list items, no separators, always joined by a space."""
    t = normalize_markers(F.coalesce(text, F.lit("")), s)
    t = F.regexp_replace(t, LINE_END, "\n")
    t = _sub(t, (rf"(?md)^{WS_IN_LINE}+|{WS_IN_LINE}+$", ""), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", ""))
    return strip(F.regexp_replace(t, rf"(?<!\n)\n(?!\n|{_ITEM})", " "))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def logical_bullets(text: Column) -> Column:
    """List markers of a text's lines, in order."""
    found = F.transform(lines(text), lambda x: F.regexp_extract(x, rf"\A{WS}*({_BULLET})", 1))
    return F.filter(found, lambda x: x != "")


_LABEL = rf"(?iu)\A{WS}*(?:{"|".join(RESPONSE_LABELS)}){WS}*:{WS}*"
_FENCE = rf"(?is)\A{WS}*```(?:json|markdown|md|text)?{WS}*\n?(.*?)\n?```{WS}*\z"


def _unwrapped(text: Column, label: str, fence: str) -> Column:
    text = strip(F.regexp_replace(text, label, ""))
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)


def strip_wrappers(text: Column) -> Column:
    """A response without its byte-order mark, known labels and code fences (twice)."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\x{feff}+", ""))
    return _unwrapped(_unwrapped(t, _LABEL, _FENCE), _LABEL, _FENCE)


def normalize_translation(text: Column, s: Settings = Settings()) -> Column:
    """A cleaned response; from Chinese to a non-CJK language, full-width punctuation becomes ASCII."""
    t = strip_wrappers(text)
    if s.source_lang.lower().startswith("zh") and not s.target_lang.lower().startswith(("zh", "ja")):
        for wide, narrow in PUNCTUATION:
            t = F.replace(t, F.lit(wide), F.lit(narrow))
        t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return strip(t)


def anchors(text: Column, s: Settings = Settings()) -> Column:
    """All cross references of a text: array of (kind, raw, num), figures first."""
    found = []
    for kind in ("fig", "tab"):
        if pattern := s.source_anchor(kind):
            p = F.lit(java(pattern))
            pairs = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("raw"), F.regexp_extract_all(text, p, F.lit(1)).alias("num"))
            found.append(_of_kind(pairs, kind))
    return F.concat(*found) if found else F.array().cast("array<struct<kind: string, raw: string, num: string>>")


def _of_kind(pairs: Column, kind: str) -> Column:
    return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), x["raw"].alias("raw"), x["num"].alias("num")))


def anchor_numbers(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?iu)" if ignore_case else "") + java(pattern)), F.lit(1))


def anchors_match(source: Column, target: Column, s: Settings = Settings()) -> Column:
    """Whether the target repeats just the source's reference numbers, for each kind, as bags."""
    ok = F.lit(True)
    for kind in ("fig", "tab"):
        if not (pattern := s.source_anchor(kind)):
            continue
        label = s.target_label(kind).rstrip(".")
        said = rf"{re.escape(label)}\.?\s*(\d+(?:[-.]\d+)+)" if label else s.target_anchor(kind)
        ok = ok & (F.array_sort(anchor_numbers(source, pattern)) == F.array_sort(anchor_numbers(target, said, True)))
    return ok


_NO_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
#: A word with a digit or ``://``, with what is glued to it: the word before a digit, and words after that begin with one.
_GLUE = rf"(?<=[A-Za-z]){WS}++(?=\p{{Nd}})"
_TELLING = rf"(?<!{_NO_WS})(?:{_NO_WS}++{_GLUE})?(?={_NO_WS}*?(?:\p{{Nd}}|://)){_NO_WS}++(?:{_GLUE}{_NO_WS}++)*+"
_URL = rf"(?i)https?://[^\t-\r\x1c-\x20\x85\p{{Z}}<>()]+"
_CODE_END = rf"(?![A-Za-z0-9]|[-_/.:]?{MARK})"
_CODE = r"(?<![A-Za-z0-9])%s[A-Za-z][A-Za-z0-9]*+(?:[-_/.:][A-Za-z0-9]++)*+" + _CODE_END
#: Possessive, so that the matcher loops and does not recurse over a long token.
_DIGIT_AHEAD = r"(?=(?:[A-Za-z]++|[-_/.:](?=[A-Za-z0-9]))*+[0-9])"
#: A number that begins as a code's last part goes on after it, and is no number of its own.
_NUMBER_TAIL = r"(?:(?<=[-_/.:][0-9]{1,32})(?:[.,]\p{Nd}++)*+)?"
_NUMBER = r"(?<![A-Za-z0-9])\p{Nd}+(?:[.,]\p{Nd}+)*"


def critical_tokens(text: Column) -> Column:
    """URLs, codes with a digit, and numbers that a translation must keep: array of ``kind:value``, with repeats.

    Later kinds don't look inside spans of earlier ones: those are blanked by a mark first.  One pass keeps the
    words that can hold a token, or are glued to one that can; all others are never looked at again.
    """
    t = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TELLING), F.lit(0)), " | ")
    t = _sub(t, (r"(?i)(?<![A-Za-z0-9])(i[3579])-(\p{Nd}+)(?![A-Za-z0-9])", "$1 $2"), (rf"(?<=[A-Za-z]){WS}+(?=\p{{Nd}})", ""))
    urls = F.transform(F.regexp_extract_all(t, F.lit(_URL), F.lit(0)), lambda x: F.concat(F.lit("url:"), F.lower(F.regexp_replace(x, r"[.,;!?:]+\z", ""))))
    t = F.regexp_replace(t, _URL, MARK)
    code = _CODE % _DIGIT_AHEAD
    codes = F.transform(F.regexp_extract_all(t, F.lit(code), F.lit(0)), lambda x: F.concat(F.lit("code:"), F.lower(x)))
    t = F.regexp_replace(t, code + _NUMBER_TAIL, MARK)
    numbers = F.transform(F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(0)), lambda x: F.concat(F.lit("num:"), F.replace(x, F.lit(","), F.lit("."))))
    return F.concat(urls, codes, numbers)


def bag_minus(a: Column, b: Column) -> Column:
    """Elements of ``a`` beyond their count in ``b``, sorted, with repeats."""

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    left = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.array_repeat(x, F.greatest(count(a, x) - count(b, x), F.lit(0))))
    return F.flatten(left)


def has_script(text: Column, lang: str) -> Column:
    """Whether a text has a letter of the language's script; of any for ``auto``."""
    return text.rlike(f"[{script_class(lang)}]")


def has_target_letters(text: Column, lang: str) -> Column:
    base = base_language(lang)
    body = CYRILLIC if base in ("ru", "uk", "bg", "sr") else HAN_COMPAT if base == "zh" else HAN_COMPAT + r"\x{3040}-\x{30ff}" if base == "ja" else r"\p{L}"
    return text.rlike(f"[{body}]")


#: Characters that count as text of a target language.
TARGET = {
    "ru": CYRILLIC,
    "zh": HAN_COMPAT + r"\x{20000}-\x{323af}",
    "ja": HAN_COMPAT + r"\x{20000}-\x{323af}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}",
}


def _count(text: Column, body: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{body}]", ""))


def target_chars(text: Column, lang: str) -> Column:
    base = (lang or "").lower().split("-", 1)[0]
    if base in ("en", "de", "fr", "es"):
        return _count(text, r"\p{IsLatin}&&\p{L}")
    return _count(text, TARGET.get(base, r"\p{L}"))


def han_chars(text: Column) -> Column:
    return _count(text, TARGET["zh"])


def meaningful_chars(text: Column) -> Column:
    return _count(text, r"\p{L}\p{N}")


def content_weight(text: Column, markers: str = Settings().bullet_chars) -> Column:
    """Characters that are neither white space, private-use nor list markers."""
    marks = "".join(f"\\x{{{ord(c):x}}}" for c in markers)
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}|[{PUA}{marks}]", ""))


def invalid_markers(text: Column) -> Column:
    return F.array_compact(F.array(F.when(F.contains(text, F.lit("\ufffd")), "U+FFFD"), F.when(F.contains(text, F.lit("\0")), "NUL")))


def anchor_dashes(text: Column) -> Column:
    """Soft hyphens and three dashes as plain hyphens."""
    return F.translate(F.coalesce(text, F.lit("")), "\u00ad\u2010\u2011\u2212", "----")


_MD_LABEL = rf"(?iu)\A{WS}*(?:{"|".join(MARKDOWN_LABELS)}){WS}*:{WS}*"
_MD_FENCE = r"(?is)\A```(?:markdown|md|text)?%s*\n?(.*?)\n?```\z" % WS
_MD_HEADS = "|".join(MARKDOWN_HEADS)


def clean_markdown(text: Column) -> Column:
    """Model output without labels, fences, service headings and outer rules."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\x{feff}+", ""))
    t = F.regexp_replace(_unwrapped(_unwrapped(t, _MD_LABEL, _MD_FENCE), _MD_LABEL, _MD_FENCE), LINE_END, "\n")
    blank = rf"(?:{WS_IN_LINE}*(?:\n|\z))"
    t = F.regexp_replace(t, rf"\A(?:{WS_IN_LINE}*\n)+", "")
    t = F.regexp_replace(t, rf"(?iu)\A(?:{WS_IN_LINE}*[# ]*(?:{_MD_HEADS})[^\n]*(?:\n|\z)(?:{WS_IN_LINE}*\n)*)+", "")
    t = F.regexp_replace(t, rf"\A(?:{WS_IN_LINE}*---{blank})+", "")
    return strip(F.regexp_replace(t, rf"(?:(?:\A|\n){WS_IN_LINE}*---{WS_IN_LINE}*)+\z", ""))


def clean_stem(stem: Column) -> Column:
    """A file's name without its job prefix and version tails; the name itself if nothing is left."""
    t = F.when(stem.rlike(r"\A[0-9a-f]{12}_.+"), F.substr(stem, F.lit(14))).otherwise(stem)
    t = strip(F.regexp_replace(t, rf"{WS}*[Vv]\p{{Nd}}[\p{{Nd}}.]*{WS}*", " "))
    return F.coalesce(F.nullif(t, F.lit("")), stem)


def safe_name(name: Column, most: int = 80) -> Column:
    """A name without forbidden characters, of at most ``most`` characters, cut at the last space."""
    t = one_line(F.regexp_replace(name, r"""[<>:"/\\|?*\x00-\x1f]""", " "))
    cut = F.substring(t, 1, most)
    return F.when(F.length(t) > most, F.rtrim(F.when(F.contains(cut, F.lit(" ")), F.regexp_extract(cut, r"(?s)\A(.*) ", 1)).otherwise(cut))).otherwise(t)


def heading_key(text: Column) -> Column:
    """A heading without page number and dot leaders, white space deleted."""
    return squash(_sub(text, (rf"[.{WS[1:-1]}]*\p{{Nd}}+{WS}*\z", ""), (r"\.{2,}", "")))


def toc_keys(title: Column) -> tuple[Column, Column]:
    """Keys to look a contents entry up by: without dot leaders, then also without the page number."""
    first = strip(F.regexp_replace(title, r"\.{2,}", ""))
    return squash(first), squash(F.regexp_replace(first, rf"[.{WS[1:-1]}]*\p{{Nd}}+{WS}*\z", ""))


def escape_html(text: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_cell(value: Column, fallback: Column) -> Column:
    """A model's answer for one cell, without fences and matching outer quotes; the fallback if empty."""
    t = strip(F.coalesce(value, F.lit("")))
    t = strip(_sub(t, (r"(?i)\A```(?:json|text)?", ""), (r"```\z", "")))
    quoted = (F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'")))
    t = F.when(quoted, strip(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)
    return F.coalesce(F.nullif(t, F.lit("")), fallback)


def escape_csv(value: Column, delimiter: str = ",") -> Column:
    t = F.coalesce(value, F.lit(""))
    return F.when(t.rlike("[\"\n\r" + re.escape(delimiter) + "]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def _hints(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


def font_traits(name: Column) -> Column:
    """Struct (family, bold, italic) that a font's name tells of."""
    s = F.lower(F.coalesce(name, F.lit("")))
    family = F.when(s.rlike(_hints(MONO)), "mono").when(s.rlike(_hints(SERIF)), "serif").when(s.rlike(_hints(SANS)), "sans").otherwise("unknown")
    return F.struct(family.alias("family"), s.rlike(_hints(BOLD)).alias("bold"), s.rlike(_hints(ITALIC)).alias("italic"))


def section_of(title: Column, s: Settings = Settings()) -> Column:
    """Section id of a title: ``ch<n>``, a dotted number, or null."""
    p, t = s.sections(), strip(title)
    chapter, num = java(p["chapter"]), java(p["num"])
    return F.when(t.rlike(chapter), F.concat(F.lit("ch"), F.regexp_extract(t, chapter, 1))).when(t.rlike(num), F.regexp_extract(t, num, 1))


def _holds(text: Column, pattern: str) -> Column:
    """Whether a pattern is found; if it begins with plain letters, only texts that contain these are searched."""
    letters = re.match(r"(\w+)(?![?*{|])", pattern)
    found = text.rlike(java(pattern))
    if not letters or "|" in pattern:
        return found
    return F.contains(text, F.lit(letters[1])) & found


def classify(text: Column, toc_title: Column | None = None, s: Settings = Settings()) -> Column:
    """Struct (type, section) of a segment's text, by the first rule that fits."""
    t, p = strip(text), s.sections()
    kind = F.when(t == "", "empty")
    section = F.when(t == "", F.lit(None).cast("string"))
    if toc_title is not None:
        kind = kind.when(toc_title.isNotNull(), "heading")
        section = section.when(toc_title.isNotNull(), section_of(toc_title, s))
    heading = t.rlike("|".join(f"(?:{java(p[k])})" for k in ("chapter", "num", "num_only")))
    kind = kind.when(heading, "heading")
    for name in ("fig", "tab"):
        if pattern := s.source_anchor(name):
            kind = kind.when(_holds(t, pattern), f"caption_{name}")
    item = t.rlike("|".join(f"(?:{java(x)})" for x in (LIST_NUMBER, LIST_BULLET)))
    return F.struct(kind.when(item, "listItem").otherwise("paragraph").alias("type"), section.when(heading, section_of(t, s)).alias("section"))


def is_listlike(kind: Column, text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (kind == "listItem") | t.rlike(rf"\A\p{{Nd}}+[.)]{WS}+\P{{Z}}") | t.rlike(rf"\A[•\-–—▪]{WS}+\P{{Z}}")


def wrap(text: Column, width: Column, char_width: float = 1.0) -> Column:
    """Greedy word wrap with one width for every character: array of lines; long words are split."""
    most = F.greatest(F.floor(width / char_width), F.lit(1)).cast("int")

    def of(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, f"{WS}+", -1), lambda w: w != "")
        parts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), ((F.length(w) - 1) / most).cast("int")), lambda i: F.substring(w, i * most + 1, most))))
        empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

        def add(a: Column, x: Column) -> Column:
            fits = F.length(a["cur"]) + 1 + F.length(x) <= most
            return F.when(a["cur"] == "", F.struct(a["out"].alias("out"), x.alias("cur"))).when(fits, F.struct(a["out"].alias("out"), F.concat(a["cur"], F.lit(" "), x).alias("cur"))).otherwise(F.struct(F.array_append(a["out"], a["cur"]).alias("out"), x.alias("cur")))

        return F.aggregate(parts, empty, add, lambda a: F.array_append(a["out"], a["cur"]))

    return F.flatten(F.transform(lines(text), of))
