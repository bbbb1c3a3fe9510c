"""Column library of the text predicates.  Everything here stays inside whole-stage codegen or
Catalyst's collection functions; nothing calls Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point classes as Java regex classes.
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
ZERO_WIDTH_NARROW = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
TAG = r"[\x{E0000}-\x{E007F}]"
MATH = r"[\x{1D400}-\x{1D7FF}]"
# Confusable characters and the Latin letters that they look like, place by place.
CONFUSABLE = "аеорсухіјѕАВЕКМНОРСТХІαονρυΑΒΕΗΙΚΜΝΟΡΤΧΥΖոօᎠᎬᎢᏄａｅｏｐ𝐚𝐞𝐨"
LATIN = "aeopcyxijsABEKMHOPCTXIaovpuABEHIKMNOPTXYZnoDTRVaeopaeo"
CONFUSABLE_CLASS = f"[{CONFUSABLE}]"
# Payloads too common to correlate.
STOPWORDS = ["test", "hello", "admin", "password", "payload", "marker", "example", "sample", "placeholder", "lorem ipsum", "null", "undefined", "none", "true", "false", "hidden", "secret"]
# Shapes of generated ciphers, and of texts that address a model.
BASE64_RUN, HEX_RUN = "[A-Za-z0-9+/]{40,}={0,2}", "[0-9A-Fa-f]{64,}"
INJECTION = [
    r"\bignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instruction|direction|prompt|command|rule)s?\b",
    r"\b(?:system|assistant|user)\s*:\s*",
    r"\boverride\s+(?:the\s+|your\s+)?(?:instruction|direction|rule|directive|command|policy)s?\b",
    r"\b(?:you\s+are\s+now|you\s+are\s+an?\s+AI|as\s+an?\s+AI)\b",
    r"\bforget\s+(?:everything|your|all|the)\b",
]


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def tag_shadow(text: Column) -> Column:
    """The ASCII text that TAG characters spell; '?' for those that stand for no printable one."""
    tags = F.array_join(F.regexp_extract_all(text, F.lit(f"({TAG})"), F.lit(1)), "")
    return F.translate(tags, "".join(chr(0xE0000 + i) for i in range(128)), "".join(chr(i) if 32 <= i < 127 else "?" for i in range(128)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_homoglyph(word: Column) -> Column:
    n = count(word, CONFUSABLE_CLASS)
    return (F.length(word) >= 2) & (n >= 1) & (word.rlike("[A-Za-z]") | (n >= 2))


def homoglyph_words(text: Column) -> Column:
    """Array of (word, recovered) of the suspicious words of a text."""
    found = F.when(text.rlike(CONFUSABLE_CLASS), F.filter(words(text), is_homoglyph))
    return F.transform(found, lambda w: F.struct(w.alias("word"), F.translate(w, CONFUSABLE, LATIN).alias("recovered")))


def normal_payload(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")))


def entropy(text: Column) -> Column:
    """Bits a character; characters are counted within the row."""
    # for each distinct character the text without it is that much shorter: no loop over pairs of characters
    share = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def fingerprint(payload: Column) -> Column:
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 12)


def injected(text: Column) -> Column:
    out = F.lit(False)
    for p in INJECTION:
        out = out | text.rlike(f"(?i){p}")
    return out
