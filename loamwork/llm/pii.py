"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation, in SQL functions only."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: A longer value is permuted in stretches of so many characters, for each half must fit a bigint.
STRETCH = 24

#: Session setting that holds the key.
KEY_SETTING = "loamwork.pii.key"
_own_keys: dict[str, str] = {}

#: Lengths of the IBANs of countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}

#: Fixed value: how access tokens of well-known services begin; the beginning is kept.
TOKEN_STARTS = r"(?:AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|[prs]k_(?:live|test)_|xox[abeprs]-|sk-(?:proj-)?)"


def _iban() -> str:
    """Groups may be spaced where the country's length is known; what follows, even capital words, is no part of it."""
    known = "|".join(f"(?:{'|'.join(c.split())})\\d\\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d)(?:{known}|[A-Z]{{2}}\d\d[A-Z0-9]{{11,30}}+)(?![A-Za-z0-9])"


#: What is looked for, in this order; a Java pattern each.  No pattern can backtrack over a long run.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)++\p{L}{2,24}+(?![\p{L}\p{N}@])",
    "iban": _iban(),
    "token": rf"(?<![A-Za-z0-9_-])(?=[Agprsx]){TOKEN_STARTS}[A-Za-z0-9_-]{{16,255}}+(?![A-Za-z0-9_-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9]|[.,-]\d)",
    "ssn": r"(?<![A-Za-z0-9.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![A-Za-z0-9]|-\d)",
    "phone": r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}+|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![A-Za-z0-9]|-\d)",
    "national": r"(?<![A-Za-z0-9+./-])(?:0[1-9]\d{1,3}[ /-]\d{5,8}|0[1-9]\d{1,3} \d{3,4} \d{3,4}|0[1-9](?:[ .-]\d\d){4}|\d{3}\.\d{3}\.\d{4})(?![A-Za-z0-9]|[./-]\d)",
    "ipv4": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![A-Za-z0-9]|\.\d)",
    "date": r"(?<![A-Za-z0-9./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![A-Za-z0-9]|[./-]\d)",
}


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; where there is none, one made up for this application."""
    own = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _own_keys.setdefault(own, secrets.token_hex(32))


def _round_key(spark: SparkSession, key: str) -> str:
    """What the rounds hash, made of the key; Spark is told to blot such values out of plan texts."""
    blot, setting = r"\b[0-9a-f]{64}\b", "spark.sql.redaction.string.regex"
    now = spark.conf.get(setting, None)
    if not now or blot not in now:
        spark.conf.set(setting, f"(?:{now})|{blot}" if now else blot)
    return hashlib.sha256(key.encode()).hexdigest()


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


def _combined() -> str:
    """All patterns as alternatives; the back-reference is renumbered by naming its group."""
    return "|".join(f"(?:{p})" for p in PATTERNS.values()).replace("([ -])", "(?<gap>[ -])").replace(r"\1", r"\k<gap>")


def _let(value: str, name: str, body: str) -> str:
    """SQL for *body* with *name* standing for *value*, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _luhn_sum(digits: str, doubled: int) -> str:
    """SQL for the Luhn sum of a string of digits; doubled: 1 doubles from the second last on, 0 from the last."""
    one = f"cast(substr({digits}, length({digits}) - k, 1) as bigint)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (s, k) -> s + if(k % 2 = {doubled}, ({one} * 2) div 10 + ({one} * 2) % 10, {one}))"


def _mod97(text: str) -> str:
    """SQL for the rest modulo 97 of an IBAN, its first four characters moved to the end."""
    turned = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0, (s, c) -> if(c >= '0' and c <= '9', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _number(values: str, radices: str) -> str:
    return f"aggregate(zip_with({values}, {radices}, (v, q) -> struct(v, q)), 0L, (s, x) -> s * x.q + x.v)"


def _product(radices: str) -> str:
    return f"aggregate({radices}, 1L, (s, q) -> s * q)"


def _digits(number: str, radices: str) -> str:
    """SQL that writes a number in mixed radices."""
    rest = f"aggregate(slice({radices}, k + 2, size({radices})), 1L, (s, q) -> s * q)"
    return f"transform(if(size({radices}) = 0, array(), sequence(0, size({radices}) - 1)), k -> ({number} div {rest}) % {radices}[k])"


def _permuted(values: str, radices: str, tweak: str, key: str) -> str:
    """SQL for the Feistel permutation of an array of values below their radices.

    The array is halved; each half is a number in mixed radices.  In turn a
    keyed hash of one half is added to the other, modulo that one's product of
    radices, so that every round, and hence the whole, is a permutation of the
    format's values.
    """
    mixed = "cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, i, {x}), 256), 1, 15), 16, 10) as bigint)"
    to_left = mixed.format(key=key, tweak=tweak, x="z.r")
    to_right = mixed.format(key=key, tweak=tweak, x="z.l")
    rounds = (
        f"aggregate(sequence(0, {ROUNDS - 1}), struct(h.l as l, h.r as r), (z, i) -> if(i % 2 = 0, "
        f"struct((z.l + {to_left}) % h.a as l, z.r as r), struct(z.l as l, (z.r + {to_right}) % h.b as r)))"
    )
    out = _let(rounds, "e", f"concat({_digits('e.l', 'h.p')}, {_digits('e.r', 'h.q')})")
    halves = "struct(slice(v, 1, size(v) div 2) as x, slice(v, size(v) div 2 + 1, size(v)) as y, slice(u, 1, size(v) div 2) as p, slice(u, size(v) div 2 + 1, size(v)) as q)"
    numbers = f"struct(g.p as p, g.q as q, {_number('g.x', 'g.p')} as l, {_number('g.y', 'g.q')} as r, {_product('g.p')} as a, {_product('g.q')} as b)"
    return _let(values, "v", _let(radices, "u", _let(halves, "g", _let(numbers, "h", out))))


def _char_value(c: str) -> str:
    return f"case when {c} rlike '^[0-9]$' then cast({c} as bigint) when {c} rlike '^[a-z]$' then ascii({c}) - 97L when {c} rlike '^[A-Z]$' then ascii({c}) - 65L else ascii({c}) % 26L end"


def _char_of(value: str, like: str) -> str:
    return f"case when {like} rlike '^[0-9]$' then cast({value} as string) when {like} rlike '^[A-Z]$' then chr({value} + 65) else chr({value} + 97) end"


def _body_permuted(body: str, tweak: str, key: str) -> str:
    """SQL that permutes the letters and digits of a string within their classes; the rest stays."""
    chars = "filter(split(t, ''), c -> c rlike '^[\\\\p{L}\\\\p{N}]$')"
    stretch = f"slice(a, w * {STRETCH} + 1, {STRETCH})"
    radices = "transform(s0, c -> if(c rlike '^[0-9]$', 10L, 26L))"
    values = f"transform(s0, c -> {_char_value('c')})"
    own = _let(stretch, "s0", _permuted(values, radices, f"concat({tweak}, ':', size(a), ':', w)", key))
    new = f"flatten(transform(sequence(0, (size(a) - 1) div {STRETCH}), w -> {own}))"
    joined = f"aggregate(split(t, ''), struct('' as s, 0 as k), (x, c) -> if(c rlike '^[\\\\p{{L}}\\\\p{{N}}]$', struct(concat(x.s, {_char_of('n[x.k]', 'c')}) as s, x.k + 1 as k), struct(concat(x.s, c) as s, x.k as k))).s"
    return _let(body, "t", _let(chars, "a", f"if(size(a) = 0, t, {_let(new, 'n', joined)})"))


def _hex_permuted(body: str, key: str) -> str:
    """SQL that permutes a string of hexadecimal digits, letters in the case that it has."""
    stretch = f"transform(sequence(w * {STRETCH} + 1, least(length(t), (w + 1) * {STRETCH})), k -> cast(conv(substr(t, k, 1), 16, 10) as bigint))"
    own = _let(stretch, "s0", _permuted("s0", "transform(s0, c -> 16L)", "concat('secret:', length(t), ':', w)", key))
    new = f"array_join(flatten(transform(sequence(0, (length(t) - 1) div {STRETCH}), w -> transform({own}, c -> hex(c)))), '')"
    return _let(body, "t", f"if(t = lower(t), lower({new}), {new})")


def _pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of a match; the match itself if it is not valid."""
    match = {k: f"{m} rlike {_raw('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    at = f"instr({m}, '@')"
    email = f"concat({_body_permuted(f'left({m}, {at} - 1)', _sql_str('email'), key)}, substr({m}, {at}))"

    plain = f"replace({m}, ' ', '')"
    body = _body_permuted(f"substr({m}, 5)", f"concat('iban:', left({m}, 2))", key)
    iban = _let(f"concat(left({m}, 2), '00', {body})", "f", _let(f"98 - {_mod97(_sql_no_space('f'))}", "d", "concat(left(f, 2), lpad(cast(d as string), 2, '0'), substr(f, 5))"))
    iban = f"if({_mod97(plain)} = 1 and {m} rlike '^..[0-9]{{2}}.*[0-9]', {iban}, {m})"

    digits = f"regexp_replace({m}, '[^0-9]', '')"
    inner = _body_permuted(f"substr({m}, 2, length({m}) - 2)", "concat('card:', left(t0, 1))", key)
    check = "cast((10 - " + _luhn_sum("b", 0) + " % 10) % 10 as string)"
    card = _let(f"concat(left({m}, 1), {inner})", "f", _let("regexp_replace(f, '[^0-9]', '')", "b", f"concat(f, {check})"))
    card = _let(digits, "t0", f"if({_luhn_sum('t0', 1)} % 10 = 0 and t0 rlike '^[2-6]', {card}, {m})")

    area = f"cast(left({m}, 3) as bigint)"
    ssn = _permuted(f"array({area} - if({area} > 666, 2, 1), cast(substr({m}, 5, 2) as bigint) - 1, cast(right({m}, 4) as bigint) - 1)", "array(898L, 99L, 9999L)", _sql_str("ssn"), key)
    ssn = _let(ssn, "n", "concat_ws('-', lpad(cast(n[0] + if(n[0] > 664, 2, 1) as string), 3, '0'), lpad(cast(n[1] + 1 as string), 2, '0'), lpad(cast(n[2] + 1 as string), 4, '0'))")

    code = rf"regexp_extract({m}, r'^(?:\+\d{{1,3}})?', 0)"
    phone = _let(code, "f", f"concat(f, {_body_permuted(f'substr({m}, length(f) + 1)', _sql_str('phone'), key)})")

    national = _let(f"if({m} like '0%', '0', '')", "f", f"concat(f, {_body_permuted(f'substr({m}, length(f) + 1)', _sql_str('phone'), key)})")

    start = _let(f"regexp_extract({m}, {_raw('^' + TOKEN_STARTS)}, 0)", "f", f"concat(f, {_body_permuted(f'substr({m}, length(f) + 1)', _sql_str('token:') + ' || f', key)})")
    token = f"if({m} rlike '[0-9]', {start}, {m})"

    octets = f"transform(split({m}, r'\\.'), x -> cast(x as bigint))"
    ipv4 = f"array_join(transform({_permuted(octets, 'array(256L, 256L, 256L, 256L)', _sql_str('ipv4'), key)}, x -> cast(x as string)), '.')"

    # A century has 36524 = 92 * 397 days from 1900, 36525 = 75 * 487 from 2000.
    form = f"case when {m} like '%-%' then 'yyyy-MM-dd' when {m} like '%/%' then if(cast(left({m}, 2) as int) > 12, 'dd/MM/yyyy', 'MM/dd/yyyy') else 'dd.MM.yyyy' end"
    start = "if(year(y) < 2000, date'1900-01-01', date'2000-01-01')"
    value = "datediff(y, s)"
    radices = "if(year(s) = 1900, array(92L, 397L), array(75L, 487L))"
    moved = _permuted(f"array({value} div {radices}[1], {value} % {radices}[1])", radices, "concat('date:', year(s))", key)
    date = _let(form, "f", _let(f"cast(try_to_timestamp({m}, f) as date)", "y", f"if(y is null, {m}, {_let(start, 's', _let(moved, 'n', f'date_format(date_add(s, cast(n[0] * {radices}[1] + n[1] as int)), f)'))})"))

    parts = {"email": email, "iban": iban, "secret": f"if({m} rlike '[0-9]' and {m} rlike '[A-Fa-f]', {_hex_permuted(m, key)}, {m})", "card": card, "ssn": ssn, "phone": phone, "national": national, "token": token, "ipv4": ipv4, "date": date}
    return "case " + " ".join(f"when {match[k]} then {parts[k]}" for k in PATTERNS) + f" else {m} end"


def _sql_str(text: str) -> str:
    return f"'{text}'"


def _sql_no_space(name: str) -> str:
    return f"replace({name}, ' ', '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """Replace personal data in every whole text by pseudonyms of the same format.

    E-mail addresses (the local part), IBANs, payment cards, social security
    numbers, telephone numbers (international, and national ones in common
    forms), IPv4 addresses, calendar dates (within their century), hexadecimal
    secrets and access tokens of well-known services (after their beginning)
    are found by one pattern.  Numbers are
    validated first: cards by Luhn's rule and a first digit of 2 to 6, IBANs by
    modulo 97, dates by the calendar; what fails stays as it is, and so does
    any text without a find.  A valid value is permuted by a keyed Feistel
    network over the values of its format, and check digits are made anew.  So
    equal values have equal pseudonyms in all documents, in any punctuation,
    and different values of a format have different ones (but for letters
    other than a-z and A-Z in addresses, which become a-z).

    Who has the key can undo the permutation, so it is no part of the program:
    without *key* the session's setting KEY_SETTING is taken and, where that is
    unset, a key made up for the application, which links values within it
    only.  The plan holds a digest of the key, which Spark's redaction of plan
    texts is set to hide.

    Returns the rows with the text replaced and, if *count_col* is given, the
    number of values replaced in that column (bigint, replacing a column of
    that name).  A null text stays null, with count 0; other columns, null ids
    and repeated rows stay; an empty table gives an empty table.  A text is
    handled by itself, without a shuffle.
    """
    spark = docs.sparkSession
    secret = _round_key(spark, session_key(spark) if key is None else key)
    rx = _raw(_combined())
    text, found, new = f"`{text_col}`", fresh(docs, "__found"), fresh(docs, "__new")
    some = f"{text} rlike '[0-9@]'"
    matches = F.expr(f"case when {some} then regexp_extract_all({text}, {rx}, 0) else cast(array() as array<string>) end")
    pseudonyms = F.expr(f"transform({found}, m -> {_pseudonym('m', _quoted(secret))})")
    joined = F.expr(f"case when size({found}) > 0 then array_join(zip_with(split({text}, {rx}), {new}, (p, n) -> concat(p, coalesce(n, ''))), '') else {text} end")
    kept = [c for c in docs.columns if c != count_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), matches.alias(found)).withColumn(new, pseudonyms)
    out: list[Column] = [joined.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    if count_col:
        out.append(F.expr(f"coalesce(size(filter(zip_with({found}, {new}, (m, n) -> m <> n), x -> x)), 0)").cast("bigint").alias(count_col))
    return rows.select(*out)
