"""Personal data: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns by kind, in the order in which a place is tried; what they find is validated before it is replaced.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("phone", r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("ip", r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
)
#: Days from 1900-01-01 to 2099-12-31: the dates that are permuted.
DAYS = 73049


@dataclass(frozen=True)
class Pseudonyms:
    """key: the secret of the permutations, which has no default, as who knows it can undo them; equal values get equal
    pseudonyms under one key. rounds: of the Feistel network, even."""

    key: str
    rounds: int = 10


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(rules: Pseudonyms, kind: str, size: str, value: str) -> str:
    """A keyed number of up to 60 bits from the round `i`, the kind, the size and a half."""
    return f"CAST(conv(substr(sha2(concat_ws('|', {_quoted(rules.key)}, '{kind}', CAST({size} AS string), CAST(i AS string), CAST({value} AS string)), 256), 1, 15), 16, 10) AS bigint)"


def permuted_digits(digits: str, kind: str, rules: Pseudonyms) -> str:
    """SQL of the digits permuted among all strings of as many digits (2 to 36).

    The halves have length div 2 and the rest; each round adds a keyed number of the right half to the left one, modulo
    its number of values, and swaps them.
    """
    n = f"length({digits})"
    left, right = f"({n} div 2)", f"({n} - {n} div 2)"
    start = f"named_struct('a', CAST(substr({digits}, 1, {left}) AS bigint), 'b', CAST(substr({digits}, {left} + 1) AS bigint))"
    modulus = f"CAST(power(10, CASE WHEN i % 2 = 0 THEN {left} ELSE {right} END) AS bigint)"
    step = f"named_struct('a', h.b, 'b', (h.a + {_round(rules, kind, n, 'h.b')} % {modulus}) % {modulus})"
    done = f"concat(lpad(CAST(h.a AS string), CAST({left} AS int), '0'), lpad(CAST(h.b AS string), CAST({right} AS int), '0'))"
    return f"aggregate(sequence(0, {rules.rounds - 1}), {start}, (h, i) -> {step}, h -> {done})"


def permuted_bits(value: str, bits: int, kind: str, rules: Pseudonyms) -> str:
    """SQL of a number under 2 ** bits (even) permuted among those."""
    half = 1 << bits // 2
    step = f"named_struct('a', h.b, 'b', (h.a + {_round(rules, kind, str(bits), 'h.b')}) % {half})"
    return f"aggregate(sequence(0, {rules.rounds - 1}), named_struct('a', ({value}) div {half}, 'b', ({value}) % {half}), (h, i) -> {step}, h -> h.a * {half} + h.b)"


def luhn_sum(digits: str) -> str:
    """SQL of the Luhn sum of digits, every second from the right doubled, the last one not."""
    d = f"CAST(substr({digits}, length({digits}) - k, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, k) -> s + CASE WHEN k % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"


def refilled(shape: str, digits: str) -> str:
    """SQL of `shape` with its digits replaced by `digits` in order."""
    chars = f"split({shape}, '')"
    step = f"CASE WHEN c RLIKE '[0-9]' THEN named_struct('t', concat(s.t, substr({digits}, s.n, 1)), 'n', s.n + 1) ELSE named_struct('t', concat(s.t, c), 'n', s.n) END"
    return f"aggregate({chars}, named_struct('t', '', 'n', 1), (s, c) -> {step}, s -> s.t)"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name bound to value, so that the value is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def replacement(value: str, rules: Pseudonyms) -> str:
    """SQL of struct(kind, text): the kind and the pseudonym of a found value, or an empty kind and the value if it isn't valid."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"

    def made(kind: str, text: str) -> str:
        return f"named_struct('kind', '{kind}', 'text', {text})"

    none = made("", value)
    local = f"translate(substr(sha2(concat_ws('|', {_quoted(rules.key)}, 'email', lower({value})), 256), 1, 12), '0123456789', 'ghijklmnop')"
    host = f"translate(substr(sha2(concat_ws('|', {_quoted(rules.key)}, 'host', lower(substring_index({value}, '@', -1))), 256), 1, 8), '0123456789', 'ghijklmnop')"
    email = made("email", f"concat({local}, '@', {host}, '.example')")
    code = f"(length(d) - 10)"
    phone = _let("d", digits, made("phone", refilled(value, f"concat(substr(d, 1, {code}), {permuted_digits(f'substr(d, {code} + 1)', 'phone', rules)})")))
    # an area of 000, 666 or from 900 on, a group of 00 and a serial of 0000 are never issued; what is walks the cycle of the
    # permutation until it meets one that is issued, which nine in ten are
    issued = lambda x: f"(NOT {x} RLIKE '^(000|666|9)' AND substr({x}, 4, 2) <> '00' AND substr({x}, 6) <> '0000')"
    cycle = f"aggregate(sequence(1, 32), named_struct('x', d, 'ok', false), (w, j) -> CASE WHEN w.ok THEN w ELSE {_let('y', permuted_digits('w.x', 'ssn', rules), f"named_struct('x', y, 'ok', {issued('y')})")} END, w -> w.x)"
    ssn = _let("d", digits, f"CASE WHEN {issued('d')} THEN {made('ssn', _let('p', cycle, refilled(value, 'p')))} ELSE {none} END")

    def date(spelled: str) -> str:
        day = f"datediff(to_date(try_to_timestamp({value}, '{spelled}')), DATE'1900-01-01')"
        # out of the range of dates, walk on along the cycle of the permutation; 48 steps all miss with probability 1e-27
        walk = f"aggregate(sequence(1, 48), named_struct('x', CAST(n AS bigint), 'ok', false), (w, j) -> CASE WHEN w.ok THEN w ELSE {_let('y', permuted_bits('w.x', 18, 'date', rules), f"named_struct('x', y, 'ok', y < {DAYS})")} END, w -> w.x)"
        return _let("n", day, f"CASE WHEN n BETWEEN 0 AND {DAYS - 1} THEN {made('date', f"date_format(date_add(DATE'1900-01-01', CAST({walk} AS int)), '{spelled}')")} ELSE {none} END")

    parts = f"transform(split({value}, '[.]'), x -> CAST(x AS bigint))"
    number = "q[0] * 16777216 + q[1] * 65536 + q[2] * 256 + q[3]"
    spelled = "concat_ws('.', CAST(z div 16777216 AS string), CAST(z div 65536 % 256 AS string), CAST(z div 256 % 256 AS string), CAST(z % 256 AS string))"
    ip = _let("q", parts, f"CASE WHEN forall(q, x -> x < 256) THEN {made('ip', _let('z', permuted_bits(number, 32, 'ip', rules), spelled))} ELSE {none} END")
    payload = permuted_digits("substr(d, 1, length(d) - 1)", "card", rules)
    checked = f"concat(p, CAST((10 - {luhn_sum("concat(p, '0')")} % 10) % 10 AS string))"
    card = _let("d", digits, f"CASE WHEN length(d) BETWEEN 13 AND 19 AND {luhn_sum('d')} % 10 = 0 THEN {made('card', _let('p', payload, _let('e', checked, refilled(value, 'e'))))} ELSE {none} END")
    return f"""CASE WHEN contains({value}, '@') THEN {email}
        WHEN startswith({value}, '+') THEN {phone}
        WHEN {value} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {date('yyyy-MM-dd')}
        WHEN {value} RLIKE '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' THEN {date('dd/MM/yyyy')}
        WHEN {value} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {ssn}
        WHEN {value} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {ip}
        ELSE {card} END"""


def pseudonymise(docs: DataFrame, rules: Pseudonyms, *, text: str = "text") -> DataFrame:
    """docs with the personal values of the text replaced, and n_<kind> (long) for each kind replaced.

    E-mail addresses get keyed names; phone numbers keep their country code and shape, national numbers and dates
    their shape; payment numbers must pass the Luhn check, addresses have bytes, dates must exist (with a slash, day
    first) and lie in 1900 to 2099, social numbers must be ones that are issued, and their pseudonyms are such too. Equal values get equal pseudonyms; different ones of a
    format get different ones, but for e-mail addresses, whose 48 and 32 bits of a keyed hash only rarely meet.
    What fails validation stays. A null text stays null with counts of 0, and repeated rows are alike. Other columns stay
    as they are, whatever their names, but for earlier n_<kind>. An empty table gives no rows; texts of any length are read
    whole. Rows stay in their partitions: nothing is shuffled.
    """
    pattern = "|".join(p for _, p in PATTERNS)
    kinds = [k for k, _ in PATTERNS]
    kept = docs.drop(*[f"n_{k}" for k in kinds])
    whole, found, gaps, made = (fresh(kept, x) for x in ("text", "found", "gaps", "made"))
    df = kept.withColumn(whole, F.col(text).cast("string"))
    df = df.withColumn(found, F.when(F.col(whole).rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(whole, pattern, -1)))
    df = df.withColumn(made, F.expr(f"transform({found}, v -> {replacement('v', rules)})"))
    put = F.concat(F.col(gaps)[0], F.array_join(F.expr(f"transform({made}, (m, i) -> concat(m.text, {gaps}[i + 1]))"), ""))
    columns = [F.when(F.size(found) > 0, put).otherwise(F.col(whole)).alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns]
    return df.select(*columns, *[F.size(F.filter(made, _is(k))).cast("long").alias(f"n_{k}") for k in kinds])


def fresh(df: DataFrame, name: str) -> str:
    """A name of a step's own column that df hasn't, however written: columns' names don't tell cases apart."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out in taken:
        out += "_"
    return out


def _is(kind: str):
    return lambda m: m["kind"] == kind


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """Each document with its text after pseudonymise, and the counts."""
    return pseudonymise(docs.select("doc_id", "text"), Pseudonyms(key))
