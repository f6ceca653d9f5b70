"""Text functions as Spark columns. All but NFKC and lossy UTF-8 decoding are built of Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MAX_SCAN_CHARS = 200_000
MIN_ENCODED = 24
MAX_CANDIDATES = 256
MIN_HIDDEN = 3
NON_ASCII = r"[^\x00-\x7F]"
TAGS = r"[\x{E0000}-\x{E007F}]"
BIDI_OVERRIDE = "[‭‮]"
#: Tags, variation selectors, bidi overrides and formatting, zero-width characters, controls.
INVISIBLE = (
    r"[\x{E0000}-\x{E007F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{202A}-\x{202E}\x{2066}-\x{2069}"
    r"\x{200B}-\x{200F}\x{FEFF}\x{2060}-\x{2064}\x{00AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
)
# Letters that look like Latin ones, Cyrillic and Greek, and what they look like.
LOOKALIKES = "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαντρικυεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKES_TO = "aeopcyxijshdqwABEKMHOPCTXIJSoavtpikueABEZHIKMNOPTYX"
# Function words of six languages.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for
from further had has have having he her here hers herself him himself his how i if in
into is it its itself just let me more most my myself no nor not now of off on once only
or other our ours ourselves out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your yours
yourself yourselves never always please must may might shall also
il lo la i gli le un uno una di a da in con su per tra fra e o ma se che chi cui non
come dove quando anche ancora sempre mai molto poco più meno questo questa questi queste
quello quella quelli quelle mi ti si ci vi ne è sono sei siamo siete era erano ho hai ha
abbiamo avete hanno del della dei delle dello al alla ai alle allo dal dalla dai dalle
nel nella nei nelle sul sulla sui sulle
el los las un una unos unas de del a al en con por para y o pero si que quien como donde
cuando también nunca siempre muy más menos este esta estos estas ese esa esos esas es son
soy eres somos sois está están fue eran ha han he hemos
la les un une des du de au aux en dans sur pour par et ou mais si que qui dont où
quand aussi jamais toujours très plus moins ce cette ces cet est sont suis es sommes êtes
était étaient a ont ai avons avez
der die das ein eine einer eines dem den des und oder aber wenn dass wer wie wo wann auch
nie immer sehr mehr weniger dieser diese dieses ist sind bin bist seid war waren hat haben
habe hast habt zu mit von für auf aus bei nach über unter vor nicht
o a os as um uma uns umas de do da dos das em no na nos nas com por para e ou mas se que
quem como onde quando também nunca sempre muito mais menos este esta estes estas esse essa
é são sou és somos sois era eram tem têm tenho
""".split()


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def beyond_ascii(text: Column) -> Column:
    """Whether a text has more bytes than characters: no look at the characters is needed."""
    return F.octet_length(text) != F.length(text)


def nfkc(text: Column) -> Column:
    """NFKC; only texts with non-ASCII characters travel to Python."""
    return F.coalesce(_nfkc(F.when(beyond_ascii(text), text)), text)


def strip_invisible(text: Column) -> Column:
    some = text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") | (beyond_ascii(text) & text.rlike(INVISIBLE))
    return F.when(some, F.regexp_replace(text, INVISIBLE, "")).otherwise(text)


def normalize(text: Column) -> Column:
    return strip_invisible(nfkc(text))


def decode_tags(text: Column) -> Column:
    """What the tag characters of a text spell."""
    tags = "".join(chr(0xE0000 + k) for k in range(1, 128))
    plain = "".join(chr(k) for k in range(1, 128))
    run = F.array_join(F.regexp_extract_all(text, F.lit(f"({TAGS})"), F.lit(1)), "")
    return F.when(beyond_ascii(text) & text.rlike(TAGS), F.translate(run, tags, plain)).otherwise(F.lit(""))


def hidden_text(text: Column, min_len: int = MIN_HIDDEN) -> Column:
    hidden = decode_tags(text)
    return F.when(F.length(hidden) >= min_len, F.array(hidden)).otherwise(F.array().cast("array<string>"))


def fold_lookalikes(text: Column) -> tuple[Column, Column]:
    """Text with look-alike letters folded in words that also hold Latin ones, and how many were."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    mixed = lambda w: w.rlike("[A-Za-z]")
    folded = F.array_join(F.transform(words, lambda w: F.when(mixed(w), F.translate(w, LOOKALIKES, LOOKALIKES_TO)).otherwise(w)), "")
    gone = lambda w: F.length(w) - F.length(F.translate(w, LOOKALIKES, ""))
    count = F.aggregate(F.filter(words, mixed), F.lit(0), lambda n, w: n + gone(w))
    # a range of letters is found faster than single ones
    some = beyond_ascii(text) & text.rlike(r"[\x{0370}-\x{052F}]") & text.rlike("[A-Za-z]")
    return F.when(some, folded).otherwise(text), F.when(some, count).otherwise(F.lit(0))


def base64_candidates(text: Column, min_len: int = MIN_ENCODED, most: int = MAX_CANDIDATES) -> Column:
    """Runs of the base64 alphabet that decode, by the strict rules: whole quadruples, padding only at the end."""
    runs = F.slice(F.regexp_extract_all(text, F.lit("([A-Za-z0-9+/=]{%d,})" % min_len), F.lit(1)), 1, most)
    return F.filter(runs, lambda t: (F.length(t) % 4 == 0) & t.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z"))


def hex_candidates(text: Column, most: int = MAX_CANDIDATES) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit("((?:[0-9a-fA-F]{2}){12,})"), F.lit(1)), 1, most)


@F.pandas_udf(ArrayType(StringType()))
def _decoded(tokens: pd.Series, hexes: pd.Series) -> pd.Series:
    import base64

    def one(b64, hx) -> list[str]:
        plain = [base64.b64decode(t) for t in (b64 if b64 is not None else ())] + [bytes.fromhex(t) for t in (hx if hx is not None else ())]
        texts = [p.decode("utf-8", errors="ignore") for p in plain]
        return [unicode for unicode in texts if unicode.strip()]

    return pd.Series([one(a, b) for a, b in zip(tokens, hexes, strict=True)])


def encoded_payloads(text: Column) -> Column:
    """Texts hidden in base64 and hex runs; rows without such runs don't travel to Python."""
    b64 = base64_candidates(text)
    # a run of hex digits of that length is one of the base64 alphabet
    hx = F.when(text.rlike("[A-Za-z0-9+/=]{%d}" % MIN_ENCODED), hex_candidates(text)).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(b64) > 0) | (F.size(hx) > 0), _decoded(b64, hx)).otherwise(F.array().cast("array<string>"))


def wrap_as_data(text: Column, tag: str = "USER_DATA") -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), F.replace(text, F.lit(f"</{tag}>"), F.lit("")), F.lit(f"\n</{tag}>"))


def tokens(text: Column) -> Column:
    """Distinct words of the lower-cased NFKC text."""
    return F.array_distinct(F.regexp_extract_all(nfkc(F.lower(text)), F.lit(r"(?U)(\w+)"), F.lit(1)))


def distinctive_tokens(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    return F.filter(F.array_except(tokens(text), stop), lambda w: F.length(w) > 2)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, total).when(n == 0, F.lit(0.0))


def luhn(text: Column) -> Column:
    """Whether the digits of a text, at least 13, have a right check digit."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, of a binary column under a literal key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def session_key(session: Column, principal: Column) -> Column:
    return F.when(principal.isNull(), session).otherwise(F.concat_ws("||", principal, session))


def actor_key(actor: Column) -> Column:
    return F.concat(F.lit("actor::"), actor)


def forbidden_literals(values: Column, least: int = 4) -> Column:
    """Distinct strings of at least so many characters, longest first."""
    kept = F.array_distinct(F.filter(values, lambda v: F.length(v) >= least))
    return F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def printable_runs(content: Column, run: int = 8, least: int = 12, most: int = 200) -> Column:
    """Texts in bytes: printable ASCII runs with a space in them, trimmed, one a line."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"([\x20-\x7e]{%d,})" % run), F.lit(1))
    kept = F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: (F.length(r) >= least) & r.contains(" "))
    return F.array_join(F.slice(kept, 1, most), "\n")
