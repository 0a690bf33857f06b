"""Native column expressions over text: references, citations, claims, tokens, slugs, digests."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a sentence that abstains holds, in lower case.
ABSTENTION_MARKERS = ["não há evidência", "evidência insuficiente", "não foi possível", "insuficiente para responder", "não consta", "não localizei"]

# Portuguese stop words of the analyzer (without accents, as terms are compared), and suffixes that its stemmer takes off.
STOP_WORDS = (
    "a ao aos as ate com como da das de dela dele delas deles do dos e ela elas ele eles em entre era essa essas esse esses esta estas este estes eu foi foram ha isso isto ja lhe lhes mais mas me mesmo meu minha muito na nao nas nem no nos"
    " nossa nosso num numa o os ou para pela pelas pelo pelos por qual quando que quem se seja sem ser seu seus so sua suas tambem te tem teu tu tua um uma voce voces"
).split()
SUFFIXES = "amentos imentos amento imento mente idades idade acoes ucoes icoes acao ucao icao oes aes ais eis ois ados idos adas idas ado ido ada ida ando endo indo ar er ir os as es s".split()

# Ligatures that one PDF reader gets wrong, and keys that a trace may carry.
LIGATURES = {"ą": "fi", "Ć": "fl"}
TRACE_KEYS = "correlation_id environment feature operation outcome provider retry_count service trace_id".split()
TRACE_LENGTH = 256

WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    """All Unicode white space at both ends, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """The analyzer of the sparse index: words in lower case without accents and stop words, cut to a light stem. The text
    is rewritten as a whole, as a function for each word would leave generated code."""
    plain = F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    letter = r"[\p{L}\p{N}]"
    kept = F.regexp_replace(plain, f"(?<!{letter})(?:{_alternatives(STOP_WORDS)})(?!{letter})", " ")
    # from the left the first place after three letters where a suffix ends the word: the longest one
    stems = F.regexp_replace(kept, f"(?<={letter}{{3}})(?:{_alternatives(SUFFIXES)})(?!{letter})", "")
    return F.regexp_extract_all(stems, F.lit(WORD), F.lit(0))


def _alternatives(words: list[str]) -> str:
    """Words grouped by their first letter, longest first, so that few are tried at a place."""
    first: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items()))


def stem_pattern() -> str:
    """The stemmer for a single word: at least three letters stay; of several suffixes the longest goes."""
    return f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"


def ref_parts(ref: Column) -> Column:
    """norm::article or norm::article::fragment as a struct; null if it is neither."""
    parts = F.split(ref, "::", -1)
    good = F.size(parts).isin(2, 3) & F.forall(parts, lambda p: F.length(p) > 0)
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("norm"), F.get(parts, F.lit(1)).alias("article"), F.get(parts, F.lit(2)).alias("fragment")))


def ref_text(norm: Column, article: Column, fragment: Column) -> Column:
    return F.concat_ws("::", norm, article, fragment)


def citation_candidates(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))


def citations(text: Column) -> Column:
    """Well-formed references in brackets, each once, as first seen."""
    return F.filter(citation_candidates(text), lambda c: ref_parts(c).isNotNull())


def claims(text: Column) -> Column:
    """Sentences: cut after . ! ? before a capital, a quote or a bracket."""
    return F.filter(F.transform(F.split(text, r'(?<=[.!?])\s+(?=[A-ZÀ-Ú"\[])', -1), strip), lambda s: s != "")


def abstains(sentence: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ABSTENTION_MARKERS)), lambda m: F.contains(F.lower(sentence), m))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8; if they aren't, as Windows-1252 (bytes it has no letter for become a replacement mark)."""
    high = bytes(range(0x80, 0xA0))
    western = F.translate(F.decode(raw, "ISO-8859-1"), high.decode("latin-1"), high.decode("cp1252", "replace"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(western)


#: Character references by name, most with their semicolon, and the names that do without one, longest first.
NAMED = html5
BARE = "|".join(sorted((n for n in NAMED if not n.endswith(";")), key=lambda n: (-len(n), n)))
BLANK = "|".join(sorted(re.escape(n) for n, letters in NAMED.items() if letters.isspace() and n.endswith(";")))


def references(text: Column) -> Column:
    """Character references decoded once, as browsers do: all names, decimal and hexadecimal numbers, with a semicolon or, where
    that is allowed, without. Numbers from 128 to 159 are Windows-1252; numbers that stand for nothing become a replacement mark,
    those of control characters and non-characters nothing. What is no reference stays."""
    table = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    names = F.map_keys(table)

    def read(x):
        digits = F.regexp_extract(x, "^#0*([0-9]*)", 1)
        hexadecimal = F.regexp_extract(x, "^#[xX]0*([0-9a-fA-F]*)", 1)
        number = F.when(F.length(digits) + F.length(hexadecimal) > 8, F.lit(0x110000)).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("int")).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)))
        full = F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]*;)", 1)
        name = F.when(F.array_contains(names, full), full).otherwise(F.regexp_extract(x, f"^({BARE})", 1))
        is_number = x.rlike("^#([0-9]|[xX][0-9a-fA-F])")
        return F.struct(F.when(is_number, number).alias("number"), F.when(~is_number, name).alias("name"), F.when(is_number, F.regexp_replace(x, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")).otherwise(x).alias("rest"))

    high = [(c, bytes([c]).decode("cp1252", "ignore")) for c in range(0x80, 0xA0)]
    western = F.create_map(*(F.lit(v) for c, w in high if w for v in (c, ord(w))))

    def letter(n):
        n = F.coalesce(F.element_at(western, n), n)
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        none = none & ~n.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D)  # bytes without a letter stay as they are
        lost = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(lost, "\ufffd").when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def written(r):
        named = F.concat(F.try_element_at(table, r["name"]), F.substr(r["rest"], F.length(r["name"]) + 1))
        return F.when(r["number"].isNotNull(), F.concat(letter(r["number"]), r["rest"])).when(r["name"] != "", named).otherwise(F.concat(F.lit("&"), r["rest"]))

    parts = F.split(text, "&", -1)
    after = F.transform(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), read), written)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(after, ""))).otherwise(text)


def html_lite(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, white space within text becomes a space (that of references, too),
    both ends of a block become a newline, character references are decoded."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<![^>]*>|<script([\s/][^>]*)?>.*?</script\s*>|<style([\s/][^>]*)?>.*?</style\s*>", "")
    t = F.regexp_replace(t, rf"&(?:{BLANK}|nbsp(?![A-Za-z0-9;])|#0*(?:9|10|12|13|32|160)(?:;|(?![0-9;]))|#[xX]0*(?:9|[aA]|[cC]|[dD]|20|[aA]0)(?:;|(?![0-9a-fA-F;])))", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|tr|table|h1|h2|h3|h4|h5|h6)([\s/][^>]*)?>", "\n")
    return references(F.regexp_replace(t, r"</?[a-zA-Z][^>]*>", ""))


def mended(text: Column) -> Column:
    """Ligatures of extracted PDF text."""
    for broken, right in LIGATURES.items():
        text = F.replace(text, F.lit(broken), F.lit(right))
    return text


def first_good(primary: Column, fallback: Column, least: int = 20) -> Column:
    """The primary extraction, unless it failed (null) or has fewer than `least` characters without outer white space."""
    return F.when(F.length(strip(primary)) >= least, primary).otherwise(fallback)


def context_block(hits: Column) -> Column:
    """hits: array of (rank, ids, text); blocks in rank order, as a generator is shown them."""
    one = lambda h: F.concat(F.lit("[structural_ids: "), F.array_join(h["ids"], ", "), F.lit("]\n"), h["text"])
    return F.array_join(F.transform(F.array_sort(hits), one), "\n\n")


def trace_metadata(metadata: Column) -> Column:
    """Of a map only the keys that are allowed, with values that aren't too long."""
    return F.map_filter(metadata, lambda k, v: k.isin(TRACE_KEYS) & (v.isNull() | (F.length(v) <= TRACE_LENGTH)))


def valid_run_id(run_id: Column) -> Column:
    return F.coalesce(run_id.rlike("^[0-9]{8}T[0-9]{6}Z$"), F.lit(False))


def unit_score(score: Column) -> Column:
    """A finite number from 0 to 1."""
    return F.coalesce(~F.isnan(score) & score.between(0.0, 1.0), F.lit(False))


def json_string(text: Column) -> Column:
    """A JSON string in ASCII, or null: quotes, backslashes and control characters escaped, all else beyond ASCII by UTF-16 unit."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    code = F.ascii
    pair = lambda c: F.concat(unit(F.lit(0xD800) + F.floor((code(c) - 0x10000) / 1024).cast("int")), unit(F.lit(0xDC00) + (code(c) - 0x10000) % 1024))
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def letter(c):
        out = F.when(c == '"', F.lit(named['"']))
        for k, v in list(named.items())[1:]:
            out = out.when(c == k, F.lit(v))
        return out.when((c >= " ") & (c <= "~"), c).when(code(c) < 0x10000, unit(code(c))).otherwise(pair(c))

    escaped = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), letter), "")
    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"')))


def canonical_json(**fields: tuple[str, Column]) -> Column:
    """An object with sorted keys, as `json.dumps(..., sort_keys=True)` writes it; values are (kind, column), kind string or number."""
    parts = [F.concat(F.lit(f'"{k}": '), json_string(c) if kind == "string" else F.coalesce(c.cast("string"), F.lit("null"))) for k, (kind, c) in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def short_digest(*parts: Column) -> Column:
    """Sixteen hex digits of the parts joined by bars: names of indexes and namespaces."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def ordinal_bin(score: Column) -> Column:
    """Thirds of [0, 1]."""
    return F.when(score < 1 / 3, 0).when(score < 2 / 3, 1).otherwise(2)
