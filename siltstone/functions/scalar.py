"""Scalar expressions: instants, previews, redaction, label folding, similarities."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sensitivity labels and authority tiers in rank order (fixed values).
SENSITIVITY = {"public": 0, "personal": 1, "private": 2}
AUTHORITY = {"model_inference": 1, "connector_evidence": 2, "owner_authored": 3, "owner_correction": 4}

_INSTANT = r"^(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)$"


def micros(at: Column) -> Column:
    """Microseconds from 1970 to a time without a zone, whatever the session's zone."""
    at = at.cast("timestamp_ntz")
    day = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def instant(text: Column) -> Column:
    """RFC 3339 text as struct(s: epoch seconds, n: nanoseconds), null if invalid.
    A leap second counts as the last nanosecond of its minute; offsets reach 23:59.  No session zone plays a part."""
    part = lambda i: F.regexp_extract(text, _INSTANT, i)
    leap = part(6) == "60"
    wall = F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat_ws(":", part(4), part(5), F.when(leap, "59").otherwise(part(6)))).try_cast("timestamp_ntz")
    sign = F.when(F.startswith(part(8), F.lit("-")), -1).otherwise(1)
    zone = F.when(F.upper(part(8)) == "Z", 0).otherwise(sign * (F.substring(part(8), 2, 2).cast("int") * 3600 + F.substring(part(8), 5, 2).cast("int") * 60))
    nanos = F.when(leap, 999_999_999).otherwise(F.rpad(F.coalesce(part(7), F.lit("")), 9, "0").cast("int"))
    fair = ~leap | (part(5) == "59")
    ok = F.rlike(text, F.lit(_INSTANT)) & wall.isNotNull() & fair & (part(1) > "0000")
    return F.when(ok, F.struct((F.floor(micros(wall) / 1_000_000) - zone).cast("long").alias("s"), nanos.cast("int").alias("n")))


def preview(text: Column, points: int = 160) -> Column:
    """White space collapsed, trimmed, cut to so many code points."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, points)


def text_slice(text: Column, offset: Column, span: Column) -> Column:
    """struct(slice, integrity): code points and the whole text's SHA-256."""
    return F.struct(F.substr(text, offset + 1, span).alias("slice"), F.sha2(text.cast("binary"), 256).alias("integrity"))


def normalized_object(value: Column) -> Column:
    """Lower-cased, white space collapsed, trailing punctuation and symbols dropped."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")), r"[\p{P}\p{S}]+$", ""))


def claim_key(subject: Column, predicate: Column) -> Column:
    return F.sha2(F.concat(subject.cast("binary"), F.lit(b"\x00"), predicate.cast("binary")), 256)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)


def slug(text: Column, most: int = 64) -> Column:
    """A path's segment: plain letters, digits, points, strokes, none at the ends but letters and digits; page if none is left."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(compatible(text)), r"[^a-z0-9._-]+", "-"), r"-{2,}", "-")
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"^[-.]+", ""), r"[-.]+$", ""), r"^[^a-z0-9]+", ""), 1, most)
    return F.when(cut == "", "page").otherwise(cut)


def one_line(text: Column, most: int) -> Column:
    """One line that is safe to show: control characters are spaces, spaces one, so many code points."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", " "), r"\s+", " ")), 1, most)


def folded(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.upper(compatible(label))), r"\s+", " "))


#: Kinds of redaction (fixed values).
KINDS = ("pem", "jwt", "api_token", "bearer", "authorization", "url_credentials", "secret_assignment", "seed_phrase", "control")
#: The shapes of tokens are their issuers' (fixed values).
_TOKEN = (
    r"sk-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,}"
    r"|xox[abposr]-[A-Za-z0-9-]{10,}|xapp-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
)
_ISSUERS = r"sk-|[sr]k_live_|gh[pousr]_|github_pat_|glpat-|npm_|xox[abposr]-|xapp-|AIza|AKIA|ASIA"
#: Words that name a secret (fixed values).
_NAMES = r"secret|token|passw(?:or)?d|api[ _-]?key|private[ _-]?key|credential"
# what follows a name: counts of tokens, references to shell variables and declared types are no secrets
_NAMED = (
    rf"(?i)((?!tokens?(?:_count)?[\"']?\s*+[=:]\s*+\d{{1,7}}[,;.)\]}}]*+(?!\S))(?:{_NAMES})[\w.-]{{0,64}}+[\"']?+\s*+[=:]\s*+)"
    r"(?!\[redacted:)(?!(?<==)\$(?:\w++|\{\w++\})(?!\S))(?!(?<=token: )(?:string|number|boolean|undefined|null)[,;.)\]}]*+(?!\S))"
)
_HEADER = r"(?i)(\bauthorization[\"']?+[ \t]*+[:=]\s*+[\"']?+"
#: Credentials in the order in which they are looked for: kind, expression, and what of a match stays.
CREDENTIALS = (
    ("pem", r"-----BEGIN[ \t\r\n]+[A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++){0,64}+-----END[ \t\r\n]+[A-Z0-9 ]{0,40}PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+){0,400}+)", ""),
    ("jwt", r"(?<![\w-])eyJ[\w-]++\.[\w-]++\.[\w-]*+", ""),
    ("api_token", _TOKEN, ""),
    ("bearer", _HEADER + r"bearer\s++)(?!\[redacted:)[^\s\"'<>,;]++", "$1"),
    ("bearer", r"(?i)(\bbearer\s++)(?!\[redacted:)[^\s\"'<>,;]{16,}+", "$1"),
    ("authorization", _HEADER + r"(?:(?:basic|token)\s++)?+)(?!(?:bearer|basic|token)\b)(?!\[redacted:)[^\s\"'<>,;]++", "$1"),
    ("url_credentials", r"(?<=[A-Za-z0-9+.-]://)(?!:?@)(?!\[redacted:)[^\s/@]++(?=@)", ""),
    ("secret_assignment", _NAMED + r'"(?:[^"\\\r\n]|\\[^\r\n])++', '$1"'),
    ("secret_assignment", _NAMED + r"'(?:[^'\\\r\n]|\\[^\r\n])++", "$1'"),
    ("secret_assignment", _NAMED + r"[^\s\"']++", "$1"),
)
#: Words of which two make a run of words prose rather than a seed phrase, and the least words of such a phrase (fixed values).
PROSE = "the and that with was are this from have not but you they will would which there been were what their then than".split()
SEED = 12
_EDGE = r"[\p{L}\p{N}'’_-]"
_RUN = rf"(?<!{_EDGE})[a-z]{{3,8}}+(?!{_EDGE})(?:(?:,? ?\r?\n|, ?| )[a-z]{{3,8}}+(?!{_EDGE})){{11,}}+"
#: Characters that are not seen, by which a credential could be split (fixed values).
_INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _masked_run(run: Column) -> Column:
    """A run of short words without its seed phrases.

    Each SEED words in a row with fewer than two common words are a window; what windows cover is one phrase, less the
    common words at its edges while SEED words are left."""
    number = lambda n: F.sequence(F.lit(1), n)
    common = lambda w: w.isin(*PROSE)

    def ranges(words: Column) -> Column:
        odd = F.transform(number(F.size(words) - SEED + 1), lambda i: F.size(F.filter(F.slice(words, i, SEED), common)) < 2)

        def covered(flags: Column) -> Column:
            near = lambda i: F.slice(flags, F.greatest(F.lit(1), i - SEED + 1), F.least(i, F.size(flags)) - F.greatest(F.lit(1), i - SEED + 1) + 1)
            return F.transform(number(F.size(words)), lambda i: (F.greatest(F.lit(1), i - SEED + 1) <= F.size(flags)) & F.exists(near(i), lambda f: f))

        def bounds(held: Column) -> Column:
            starts = F.filter(number(F.size(held)), lambda i: F.element_at(held, i) & ((i == 1) | ~F.get(held, i - 2)))
            ends = F.filter(number(F.size(held)), lambda i: F.element_at(held, i) & ((i == F.size(held)) | ~F.get(held, i)))
            return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("a"), z.alias("z")))

        def trimmed(r: Column) -> Column:
            inside = F.slice(words, r["a"], r["z"] - r["a"] + 1)
            real = F.filter(F.sequence(r["a"], r["z"]), lambda i: ~common(F.element_at(words, i)))
            first = F.least(F.coalesce(F.array_min(real), r["z"]), F.greatest(r["a"], r["z"] - SEED + 1))
            last = F.greatest(F.coalesce(F.array_max(real), first), F.least(r["z"], first + SEED - 1))
            return F.when(F.size(inside) > SEED, F.struct(first.alias("a"), last.alias("z"))).otherwise(r)

        return F.transform(_let(_let(odd, covered), bounds), trimmed)

    def put(words: Column) -> Column:
        gaps = F.array_append(F.regexp_extract_all(run, F.lit("[^a-z]+"), F.lit(0)), F.lit(""))

        def written(found: Column) -> Column:
            inside = lambda i: F.exists(found, lambda r: i.between(r["a"], r["z"]))
            first = lambda i: F.exists(found, lambda r: i == r["a"])
            closed = lambda i: F.exists(found, lambda r: (i >= r["a"]) & (i < r["z"]))
            word = lambda i: F.when(first(i), "[redacted:seed_phrase]").when(inside(i), "").otherwise(F.element_at(words, i))
            return F.array_join(F.zip_with(number(F.size(words)), gaps, lambda i, gap: F.concat(word(i), F.when(closed(i), "").otherwise(gap))), "")

        return _let(ranges(words), written)

    return _let(F.regexp_extract_all(run, F.lit("[a-z]+"), F.lit(0)), put)


def _without_seeds(text: Column) -> Column:
    between = F.split(text, _RUN, -1)
    runs = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), _masked_run)
    whole = F.array_join(F.zip_with(between, F.array_append(runs, F.lit("")), lambda a, b: F.concat(a, b)), "")
    return F.when(F.rlike(text, F.lit(_RUN)), whole).otherwise(text)


def _wrapped(text: Column) -> Column:
    """Tokens that a line break cuts in two: array of them as they stand."""
    shape = rf"(?:{_ISSUERS})[\w-]{{0,256}}[ \t]{{0,16}}\r?\n[ \t]{{0,16}}[\w-]++(?![ \t]*[:=])"
    whole = lambda x: F.rlike(x, F.lit(rf"^(?:{_TOKEN})"))
    head = lambda x: F.regexp_extract(x, r"^[\w-]*", 0)
    tail = lambda x: F.regexp_extract(x, r"[\w-]*$", 0)
    ends = lambda x: whole(head(x)) & (F.rlike(x, F.lit("^A[KS]IA")) | F.rlike(tail(x), F.lit(rf"^(?:{_TOKEN})")))
    alone = F.filter(F.regexp_extract_all(text, F.lit(shape + r"(?=[ \t]*(?:\r?\n|$))"), F.lit(0)), lambda x: whole(F.concat(head(x), tail(x))) & ~ends(x))
    within = F.filter(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), lambda x: whole(F.concat(head(x), tail(x))) & ~ends(x) & (~whole(head(x)) | (F.length(tail(x)) >= 16)))
    found = F.array_distinct(F.concat(alone, within))
    return F.when(F.rlike(text, F.lit(rf"(?:{_ISSUERS})[\w-]*+[ \t]*+\r?\n")), found).otherwise(F.array().cast("array<string>"))


def redacted(text: Column, seeds: bool = True) -> Column:
    """Each secret replaced by [redacted:kind], what is not seen taken out.  A seed phrase is known by its look alone, so a
    list of plain words goes as well; without ``seeds`` such runs stay."""
    text = F.regexp_replace(text, _INVISIBLE, "")
    text = _let(text, lambda t: F.aggregate(_wrapped(t), t, lambda out, x: F.replace(out, x, F.lit("[redacted:api_token]"))))
    for kind, pattern, kept in CREDENTIALS:
        text = F.regexp_replace(text, pattern, f"{kept}[redacted:{kind}]")
    return _let(text, _without_seeds) if seeds else text


def redaction_counts(text: Column) -> Column:
    """struct of KINDS: how many of each ``redacted`` takes out of a text, marks that stood in it aside."""
    marks = lambda c, kind: F.regexp_count(c, F.lit(rf"\[redacted:{kind}\]"))
    hidden = F.regexp_count(text, F.lit(_INVISIBLE))
    return _let(redacted(text), lambda out: F.struct(*((marks(out, k) - marks(text, k)).alias(k) for k in KINDS[:-1]), hidden.alias("control")))


def served(text: Column) -> Column:
    """A text as it may be shown: line ends alike, control characters gone, secrets redacted, tags made harmless."""
    lines = F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x{85}\x{2028}\x{2029}]", "\n")
    return F.replace(redacted(F.regexp_replace(lines, _CONTROL, "")), F.lit("<"), F.lit("&lt;"))


def is_credential(text: Column) -> Column:
    return _let(redacted(text), lambda out: F.regexp_count(out, F.lit(r"\[redacted:[a-z_]+\]")) > F.regexp_count(text, F.lit(r"\[redacted:[a-z_]+\]")))


# --- words ---


def _base(code: int) -> str | None:
    """The letter that is left of a character without its marks, if one is."""
    plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
    return plain if len(plain) == 1 and plain != chr(code) else None


def _wide(code: int) -> str | None:
    """The one character that a compatibility form stands for."""
    plain = unicodedata.normalize("NFKC", chr(code))
    return plain if len(plain) == 1 and plain != chr(code) else None


@cache
def _table(rule) -> tuple[str, str]:
    """All characters of the basic plane that a rule changes, and what they become."""
    pairs = [(chr(c), x) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (x := rule(c))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(text: Column) -> Column:
    """Without diacritics, composed or as marks of their own."""
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(F.translate(text, *_table(_base)), r"\p{Mn}", "")).otherwise(text)


def compatible(text: Column) -> Column:
    """Full-width, half-width and like forms as the plain characters."""
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.translate(text, *_table(_wide))).otherwise(text)


def tokens(text: Column) -> Column:
    """Words in lower case without marks, as they are compared."""
    return F.regexp_extract_all(unaccented(F.lower(text)), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
