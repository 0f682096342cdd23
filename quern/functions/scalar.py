"""Scalar functions over columns. Everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix to type.
FILE_TYPES = {
    "md": "MARKDOWN", "markdown": "MARKDOWN", "txt": "TEXT", "csv": "CSV", "pdf": "PDF", "doc": "WORD", "docx": "WORD",
    "ppt": "PPT", "pptx": "PPT", "xls": "EXCEL", "xlsx": "EXCEL", "html": "HTML", "htm": "HTML", "png": "IMAGE",
    "jpg": "IMAGE", "jpeg": "IMAGE", "webp": "IMAGE",
}


#: The white space of Unicode, as a class for regular expressions here and in SQL; what is not of it.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WHITE = WHITE.replace("[", "[^", 1)


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def characters(text: Column) -> Column:
    """The distinct lower-case characters of a text other than white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHITE, "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(plain, "")))


def char_overlap(query: Column, document: Column) -> Column:
    """Share of the query's characters that the document has; 0 for an empty query. Arguments are character arrays."""
    shared = F.size(F.array_intersect(query, document)).cast("double")
    return F.when(F.size(query) > 0, shared / F.size(query)).otherwise(F.lit(0.0))


def normalized(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHITE + "+", "")


def collapsed(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " "))


def tokens(text: Column) -> Column:
    """Search tokens: lower-case runs of letters and digits, and single ideographs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+)"), 1)


def query_tokens(text: Column) -> Column:
    """Search tokens in order of first appearance."""
    return F.array_distinct(tokens(text))


def match_query(text: Column) -> Column:
    """The text-match query of a question: its tokens, any of which may match."""
    return F.array_join(query_tokens(text), " | ")


#: A search token and what follows it up to the next one; what stands before the first one.
_UNIT, _LEAD = r"((?:[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+)[^\p{L}\p{N}]*)", r"^[^\p{L}\p{N}]*"


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_UNIT), 1)


def token_prefix(text: Column, limit: int) -> Column:
    """The longest beginning of a text that has at most `limit` tokens."""
    return F.concat(F.regexp_extract(text, _LEAD, 0), F.array_join(F.slice(_units(text), 1, limit), "")) if limit > 0 else F.lit("")


def token_suffix(text: Column, limit: int) -> Column:
    """The last part of a text that is cut into longest parts of at most `limit` tokens."""

    def last(units: Column) -> Column:
        begin = (F.floor((F.size(units) - 1) / limit) * limit).cast("int")
        part = F.array_join(F.slice(units, begin + 1, F.size(units)), "")
        return F.when(F.size(units) == 0, text).when(begin == 0, F.concat(F.regexp_extract(text, _LEAD, 0), part)).otherwise(part)

    return let(_units(text), last) if limit > 0 else F.lit("")


def context_window(parent: Column, child: Column, budget: int) -> Column:
    """What stands around a child's text in its parent's, spaces collapsed: half of the budget of tokens on each side.

    The child is found with any white space between its words. Empty where it isn't found.
    """

    def around(whole: Column, own: Column) -> Column:
        at = F.when(own == "", 0).otherwise(F.instr(whole, own))
        left, right = F.substring(whole, F.lit(1), at - 1), F.substring(whole, at + F.length(own), F.length(whole))
        window = F.concat(token_suffix(left, budget // 2), F.lit(" "), token_prefix(right, budget - budget // 2))
        return F.when(at > 0, collapsed(window)).otherwise("")

    return let(collapsed(parent), lambda whole: let(collapsed(child), lambda own: around(whole, own)))


def token_count(text: Column) -> Column:
    """Number of search tokens: the counter that chunking uses by default."""
    return F.size(tokens(text))


def search_text(*parts: Column) -> Column:
    """Tokens of all parts, joined by spaces."""
    return F.array_join(tokens(F.concat_ws(" ", *parts)), " ")


def mock_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic vector from the digest of a text: byte i mod 32 over 255, to six places."""
    byte = lambda digest, i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    return let(F.sha2(F.coalesce(text, F.lit("")), 256), lambda d: F.transform(places, lambda i: F.round(byte(d, i) / 255, 6)))


def fallback_embedding(text: Column, dimension: int = 4) -> Column:
    """Code points of the first characters mod 29, plus 1; zeros beyond the text's end."""
    at = lambda i: F.substring(text, i, F.lit(1))
    value = lambda i: F.when(F.length(text) >= i, F.ascii(at(i)) % 29 + 1).otherwise(0).cast("double")
    return F.transform(F.sequence(F.lit(1), F.lit(dimension)), value)


def file_type(name: Column) -> Column:
    """Type of a file by its suffix; null where unknown."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair)), suffix)


def retry_delay(attempt: Column, base: float = 5.0, cap: float = 600.0) -> Column:
    """Exponential backoff in seconds."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def title_path(*parts: Column) -> Column:
    """Parts joined by ' / ', blank ones dropped."""
    return F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda x: x != ""), " / ")


def evidence_section(index: Column, question: Column, answer: Column) -> Column:
    """One numbered question and answer as a section of a prompt."""
    return F.concat(F.lit("["), index.cast("string"), F.lit("] Q: "), question, F.lit("\nA: "), answer)


def source_identity(explicit: Column, derived: Column) -> Column:
    """Where a block comes from: the identity that its locator names, else the derived one. Two that differ are an error."""
    clash = explicit.isNotNull() & derived.isNotNull() & (explicit != derived)
    return F.when(clash, F.raise_error(F.concat(F.lit("two identities of one source: "), explicit, F.lit(", "), derived))).otherwise(F.coalesce(explicit, derived))


def locator_ranges(locators: Column) -> Column:
    """(block, start, end) of locators, an array of structs with block, merged_start, merged_end, source_start and
    source_end: the merged span, else the source's; those that are empty or lack an end are left out."""
    span = lambda x: F.struct(x["block"].alias("block"), F.coalesce(x["merged_start"], x["source_start"]).alias("start"), F.coalesce(x["merged_end"], x["source_end"]).alias("end"))
    return F.filter(F.transform(F.coalesce(locators, F.array()), span), lambda r: r["end"] > r["start"])


def page_range(start: Column, end: Column, page: Column) -> Column:
    """First and last page with fallbacks, as a struct."""
    first = F.coalesce(start, page, F.lit(1))
    return F.struct(first.alias("start"), F.coalesce(end, first).alias("end"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; 0 where there is nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def linear_percentile(value: Column, share: float) -> Column:
    """Percentile with linear interpolation at (n - 1) * share."""
    return F.percentile(value, F.lit(share))


def substring_score(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms in a text, letter case aside."""
    low = F.lower(text)  # some letters change their number here, so lengths are taken after it
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t) for t in terms if t]
    return reduce(lambda a, b: a + b, counts, F.lit(0.0)).cast("long")


def json_slice(text: Column) -> Column:
    """The JSON in a model's answer: without a code fence, from the first bracket to the last one."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)


#: The mask, parts of names whose values are masked whole and those that are safe, parameters masked in
#: addresses, and forms of secrets in free text.
MASK = "***REDACTED***"
SECRET_NAMES = ("authorization", "api_key", "apikey", "access_token", "refresh_token", "secret", "password", "encrypted_api_key")
SAFE_NAMES = ("key_prefix", "keyprefix")
SECRET_PARAMETER = r"(?i)((?:api[_-]?key|access[_-]?token|refresh[_-]?token|authorization|password|secret)=)[^&\s]+"
SECRET_FORM = (
    r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}|lk_(?:live|test)_[A-Za-z0-9_-]{8,}|sk-[A-Za-z0-9]{16,}"
    r"|enc:v\d+:[A-Za-z0-9_:+/=-]{8,}"
)


def redacted(text: Column) -> Column:
    """Free text without secrets: masked whole where it quotes a header, else parameters and known forms are masked."""
    header = F.contains(F.lower(text), F.lit("authorization:")) | F.contains(F.lower(text), F.lit("bearer "))
    parts = F.regexp_replace(F.regexp_replace(text, SECRET_PARAMETER, f"$1{MASK}"), SECRET_FORM, MASK)
    return F.when(header, MASK).otherwise(parts)


def redacted_payload(payload: Column) -> Column:
    """A payload as a map from names to texts: values of secret names are masked, those of safe names stay, others are
    free text."""
    plain = lambda name: F.lower(F.replace(name, F.lit("-"), F.lit("_")))
    any_of = lambda name, parts: reduce(lambda a, b: a | b, (F.contains(plain(name), F.lit(p)) for p in parts))
    value = lambda k, v: F.when(any_of(k, SAFE_NAMES), v).when(any_of(k, SECRET_NAMES), MASK).otherwise(redacted(v))
    return F.transform_values(payload, value)
