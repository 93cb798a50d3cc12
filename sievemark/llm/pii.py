"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Candidates come from one pattern. Numbers and dates that pass their checks (Luhn digit, IBAN remainder,
octets, calendar, social security ranges) are permuted within their format by a keyed
Feistel network: the value is written as (x, y) with x below a and y below b, and each round adds a keyed
hash of one half to the other, modulo its size; a * b is the size of the format, so every result is a
valid value and different values stay different. Check digits are computed anew. Separators stay where
they are and are no part of the value, so equal values stay linked across documents and spellings.
A date such as 12/25/2020, which is none with the day first, counts as one with the month first; dates keep to days over 12
or up to 12, so that every spelling reads as before and different spellings don't meet.
E-mail addresses and secrets, which have no such domain, get keyed digests in their alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import documents, unused

ROUNDS = 8
#: A key for tests; production names its own in spark.sievemark.pii.key.
DEFAULT_KEY = "not a secret"

EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
ACCESS_KEY = r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"
#: Up to the closing quote or, without quotes, to the next space or quote.
SECRET = r"""(?<=[Pp]assword=)[^\s"']{4,}|(?<=[Tt]oken = ")(?:[^"\r\n]{8,}+(?=")|[^\s"]{8,})|(?<=[Tt]oken=)[^\s"']{8,}"""
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?<between>[ -])[0-9]{4}\k<between>[0-9]{4}\k<between>[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}(?<inside>[.-])[0-9]{3}\k<inside>[0-9]{4}(?![0-9])"
#: Group 1 tells secrets, which come first: what else is found within one is no value by itself.
ANY = "|".join((f"({SECRET})", EMAIL, ACCESS_KEY, IBAN, ADDRESS, DATE, SOCIAL, CARD, PHONE))

#: Days of a block of dates, as a * b; blocks count from 1900-01-01.
DAYS_A = DAYS_B = 270
#: Dates are permuted until the day is on its side of 12; so many steps in vain have odds of about 1 in 10**27.
WALK = 128


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, kind: str, x: str, y: str, a: str, b: str) -> str:
    """SQL for struct(x, y) permuted; all arguments but key and kind are SQL for longs."""
    hashed = lambda v: f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, {_text(kind)}, {a}, {b}, r, {v}), 256), 1, 15), 16, 10) as bigint)"
    step = f"if(r % 2 = 0, named_struct('x', (s.x + {hashed('s.y')}) % {a}, 'y', s.y), named_struct('x', s.x, 'y', (s.y + {hashed('s.x')}) % {b}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint)), (s, r) -> {step})"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes value once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(key: str, kind: str, d: str) -> str:
    """SQL for digits d (2 to 34 of them) permuted."""
    low, high = f"cast(rpad('1', 1 + length({d}) div 2, '0') as bigint)", f"cast(rpad('1', 1 + length({d}) - length({d}) div 2, '0') as bigint)"
    x, y = f"substr({d}, 1, length({d}) div 2)", f"substr({d}, 1 + length({d}) div 2)"
    return _let("f", _feistel(key, kind, x, y, low, high), f"concat(lpad(cast(f.x as string), length({d}) div 2, '0'), lpad(cast(f.y as string), length({d}) - length({d}) div 2, '0'))")


def _in_place(m: str, d: str) -> str:
    """SQL that puts the digits d where m has digits."""
    return _let("p", f"split({m}, '[0-9]', -1)", f"aggregate(sequence(1, length({d})), p[0], (acc, i) -> concat(acc, substr({d}, i, 1), p[i]))")


def _luhn(d: str) -> str:
    """SQL for the Luhn sum of d, whose last digit counts once."""
    digit = f"cast(substr({d}, length({d}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (acc, i) -> acc + if(i % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"


def _mod97(s: str) -> str:
    """SQL for the IBAN remainder of s (country and check digits in front)."""
    moved = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    code = "ascii(c)"
    return f"aggregate(split({moved}, '(?!^)(?!$)'), 0, (acc, c) -> if({code} < 58, (acc * 10 + {code} - 48) % 97, (acc * 100 + {code} - 55) % 97))"


def _card(key: str) -> tuple[str, str]:
    d = "regexp_replace(m, '[^0-9]', '')"
    test = f"length({d}) between 13 and 19 and {_let('n', d, f'{_luhn("n")} % 10 = 0')}"
    body = _let("q", _digits(key, "card", f"substr({d}, 1, length({d}) - 1)"), _in_place("m", f"concat(q, cast((10 - {_luhn("concat(q, '0')")} % 10) % 10 as string))"))
    return test, body


def _iban(key: str) -> tuple[str, str]:
    s = "replace(m, ' ', '')"
    test = f"length({s}) between 15 and 34 and {_let('n', s, f'{_mod97("n")} = 1')}"
    own = f"regexp_replace(substr({s}, 5), '[^0-9]', '')"
    new = _let("q", f"if(length({own}) < 2, {own}, {_digits(key, 'iban', own)})", _in_place(f"substr({s}, 5)", "q"))
    checked = _let("b", new, f"concat(substr(m, 1, 2), lpad(cast(98 - {_mod97("concat(substr(m, 1, 2), '00', b)")} as string), 2, '0'), b)")
    spaced = _let("t", checked, "if(m like '% %', trim(regexp_replace(t, '(.{4})', '$1 ')), t)")
    return test, spaced


def _address(key: str) -> tuple[str, str]:
    o = lambda i: f"cast(split(m, '[.]')[{i}] as bigint)"
    test = " and ".join(f"{o(i)} < 256" for i in range(4))
    f = _feistel(key, "address", f"{o(0)} * 256 + {o(1)}", f"{o(2)} * 256 + {o(3)}", "65536L", "65536L")
    return test, _let("f", f, "concat_ws('.', f.x div 256, f.x % 256, f.y div 256, f.y % 256)")


def _date(key: str) -> tuple[str, str]:
    day_first, month_first = "concat_ws('-', substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2))", "concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2))"
    is_month_first = f"(m like '__/%' and try_cast({day_first} as date) is null)"
    iso = f"case when m like '____-%' then m when {is_month_first} then {month_first} else {day_first} end"
    day = f"datediff(try_cast({iso} as date), date'1900-01-01')"
    size = DAYS_A * DAYS_B
    f = _feistel(key, "date", f"pmod(n, {size}) div {DAYS_B}", f"pmod(n, {size}) % {DAYS_B}", f"{DAYS_A}L", f"{DAYS_B}L")
    permuted = _let("f", f, f"cast(n - pmod(n, {size}) + f.x * {DAYS_B} + f.y as int)")
    late = lambda n: f"(day(date_add(date'1900-01-01', {n})) > 12)"
    walk = f"aggregate(sequence(1, {WALK}), d, (n, step) -> if(step > 1 and {late('n')} = {late('d')}, n, {permuted}))"
    new = f"date_add(date'1900-01-01', {walk})"
    out = _let("d", day, _let("t", new, f"case when m like '____-%' then date_format(t, 'yyyy-MM-dd') when {is_month_first} then date_format(t, 'MM/dd/yyyy') when m like '__/%' then date_format(t, 'dd/MM/yyyy') else date_format(t, 'dd.MM.yyyy') end"))
    return f"{_let('iso', iso, "iso > '0532' and try_cast(iso as date) is not null and iso < '9899'")}", out


def _social(key: str) -> tuple[str, str]:
    area, rest = "cast(substr(m, 1, 3) as bigint)", "(cast(substr(m, 5, 2) as bigint) - 1) * 9999 + cast(substr(m, 8) as bigint) - 1"
    test = f"{area} between 1 and 899 and {area} <> 666 and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'"
    f = _feistel(key, "social", f"{area} - if({area} > 666, 2, 1)", rest, "898L", "989901L")
    return test, _let("f", f, "concat_ws('-', lpad(cast(f.x + if(f.x >= 665, 2, 1) as string), 3, '0'), lpad(cast(f.y div 9999 + 1 as string), 2, '0'), lpad(cast(f.y % 9999 + 1 as string), 4, '0'))")


def _phone(key: str) -> tuple[str, str]:
    d = "regexp_replace(m, '[^0-9]', '')"
    kept = f"substr({d}, 1, greatest(0, length({d}) - 10))"
    return f"length({d}) between 7 and 15", _let("q", _digits(key, "phone", f"substr({d}, 1 + greatest(0, length({d}) - 10))"), _in_place("m", f"concat({kept}, q)"))


def _rules(key: str) -> list[tuple[str, str, str, str]]:
    """Kind, whole pattern, further test and replacement in SQL over a match m."""
    letters = lambda tag, n: f"translate(substr(sha2(concat_ws('|', {_text(key)}, '{tag}', lower(m)), 256), 1, {n}), '0123456789abcdef', 'ghijklmnopqrstuv')"
    upper = f"concat('AKIA', substr(upper(sha2(concat_ws('|', {_text(key)}, 'key', m), 256)), 1, 16))"
    return [
        ("email", EMAIL, "true", f"concat({letters('local', 12)}, '@', substr({letters('domain', 40)}, 30, 8), '.example.net')"),
        ("access_key", ACCESS_KEY, "true", upper),
        ("iban", IBAN, *_iban(key)),
        ("address", ADDRESS, *_address(key)),
        ("date", DATE, *_date(key)),
        ("social", SOCIAL, *_social(key)),
        ("card", CARD, *_card(key)),
        ("phone", PHONE, *_phone(key)),
    ]


def _secret(key: str) -> str:
    """SQL for hex digits, as many as m has characters."""
    return f"substr(repeat(sha2(concat_ws('|', {_text(key)}, 'secret', m), 256), cast(length(m) div 64 + 1 as int)), 1, length(m))"


def _replaced(docs: DataFrame, key: str) -> tuple[DataFrame, Column, str]:
    """docs with a column of its own that holds what was found and put in its place; the new text, and that column's name. Found values come as (k, t)."""
    name = unused(docs, "_private")
    work, text = F.col(name), F.col("`text`")
    pattern = _text(ANY)
    cases = " ".join(f"when m rlike {_text('^(?:' + p + ')$')} and {test} then named_struct('k', '{kind}', 't', {body})" for kind, p, test, body in _rules(key))
    cases = f"when get({name}.secrets, i) <> '' then named_struct('k', 'secret', 't', {_secret(key)}) {cases}"
    replaced = f"transform({name}.all, (m, i) -> coalesce(case {cases} end, named_struct('k', cast(null as string), 't', m)))"
    extract = lambda where, group: f"case when `text` rlike '{where}' then regexp_extract_all(`text`, {pattern}, {group}) else cast(array() as array<string>) end"
    found = f"named_struct('all', {extract('[0-9@]|[Pp]assword=|[Tt]oken ?=', 0)}, 'secrets', {extract('[Pp]assword=|[Tt]oken ?=', 1)})"
    step = docs.withColumn(name, F.expr(found))
    step = step.withColumn(name, F.expr(f"case when size({name}.all) > 0 then {replaced} else cast(array() as array<struct<k:string,t:string>>) end"))
    joined = _let("p", f"split(`text`, {pattern}, -1)", f"aggregate(sequence(1, size({name})), p[0], (acc, i) -> concat(acc, {name}[i - 1].t, p[i]))")
    return step, F.when(F.size(work) > 0, F.expr(joined)).otherwise(text).alias("text"), name


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The columns of docs with text pseudonymised, and n_replaced and kinds (sorted, distinct) behind them.

    A null text stays null, with nothing replaced; texts without personal data stay as they are,
    whatever their length. Candidates that fail their check stay. Rows are neither dropped nor merged. Columns
    of docs named n_replaced or kinds give way here, and no others; in_texts() keeps them all. No shuffle and no Python.
    """
    step, text, name = _replaced(docs, key)
    kinds = F.filter(F.transform(F.col(name), lambda s: s["k"]), lambda k: k.isNotNull())
    kept = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_replaced", "kinds")]
    return step.select(*kept, F.coalesce(F.size(kinds), F.lit(0)).alias("n_replaced"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def in_texts(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The columns of docs, whatever their names, with text pseudonymised."""
    step, text, _ = _replaced(docs, key)
    return step.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def key_of(spark: SparkSession) -> str:
    """The key that the session names in spark.sievemark.pii.key; without one that of the tests, which hides nothing."""
    return spark.conf.get("spark.sievemark.pii.key", DEFAULT_KEY)


def query(docs: DataFrame, key: str | None = None) -> DataFrame:
    return pseudonymise(documents(docs, "doc_id", "text"), key_of(docs.sparkSession) if key is None else key)
