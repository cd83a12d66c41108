"""Operator 1: personal data by gradient boosting over candidate spans.

High-recall generators propose overlapping candidates. Each has features of its
format and of the text around it; boosted trees, written out as SQL CASE
expressions, give a score that a logistic curve calibrates, and the candidates
over their kind's own threshold become spans; those that overlap become one. The
four base kinds have exact rules and always stay. The trees are fitted on the driver
from ``SAMPLE`` written sentences (no table marks personal data); everything that
touches rows is a SQL function.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Possessive forms of the fixed patterns: the same matches in linear time and constant stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Generators of further candidates.
    "secret": r"""(?<![A-Za-z0-9])(?:(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+|(?i:password|passwd|secret|token|api_?key)\x20{0,3}[=:]\x20{0,3}["']?[A-Za-z0-9_+/.-]{8,}+)""",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,}+\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,}+(?![A-Za-z0-9])",
}
# A cheap condition without which a pattern cannot match.
NEEDS = {
    "email": "instr({t}, '@') > 0",
    "ip": "{t} rlike '[0-9][.][0-9]'",
    "card": "{t} rlike '[0-9][0-9 -]{{12}}'",
    "phone": "{t} rlike '[+][0-9]'",
    "secret": "{t} rlike 'AKIA|ghp_|sk-|xox[bp]-|[=:]'",
    "local_phone": "{t} rlike '[0-9]{{3}}[.-][0-9]{{4}}'",
    "national_id": "{t} rlike '[0-9]-[0-9]{{2}}-[0-9]'",
    "iban": "{t} rlike '[A-Z]{{2}}[0-9]{{2}}'",
    "spelled_email": "(instr({t}, '(at)') > 0 or instr({t}, '[at]') > 0)",
}
KINDS = tuple(PATTERNS)
ADDED = KINDS[len(BASE) :]
SAMPLE = 3000
FLOOR = 0.5  # no kind's threshold is lower
FEATURES = ("size", "digits", "uppers", "marks", "cue", "against", "edge", "runs", "check", "kind")
CUES = "pass|secret|token|key|tel|phone|call|fax|mail|contact|card|ssn|social|iban|account|bank|id"
AGAINST = "part|model|order|version|lot |batch|ratio|score|error|code|serial|stock|size|page|room|chapter|meet|look"
# Whether the value could be one of its kind: account numbers by their remainder, identities and phones by
# the numbers that are given out, secrets by letters with digits, addresses by a short last part.
CHECKS = {
    "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]",
    "local_phone": r"^\(?[2-9][0-9]{2}.{1,2}[2-9]",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "spelled_email": r"(?i)(?:\.|[\[(]dot[\])])\x20?[a-z]{2,4}$",
}


# --- array scans -------------------------------------------------------------
def _scan(values: str, merge: str, zero: str, name: str) -> str:
    """Running ``merge`` of the elements before each one, in chunks of 256.

    Growing an array one element at a time is quadratic; chunks keep it near linear.
    """
    part = f"slice({values}, {name}k * 256 + 1, 256)"
    chunks = f"sequence(0, cast(ceil(size({values}) / 256.0D) as int) - 1)"
    sums = f"transform({chunks}, {name}k -> aggregate({part}, {zero}, ({name}a, {name}x) -> {merge.format(a=name + 'a', x=name + 'x')}))"
    step = "named_struct('t', {m}, 'o', concat({acc}.o, array({acc}.t)))"

    def run(of: str, start: str, n: str) -> str:
        acc = f"{n}s"
        body = step.format(m=merge.format(a=f"{acc}.t", x=f"{n}y"), acc=acc)
        return f"aggregate({of}, named_struct('t', {start}, 'o', cast(array() as array<bigint>)), ({acc}, {n}y) -> {body}).o"

    bases = run(sums, zero, name + "b")
    inner = run(part, f"{name}z", name + "c")
    return (
        f"case when size({values}) = 0 then cast(array() as array<bigint>) else flatten(zip_with({chunks}, {bases}, ({name}k, {name}z) -> {inner})) end"
    )


def _found(kind: str, t: str) -> tuple[str, str]:
    p = "r'" + PATTERNS[kind].replace("'", "\\x27") + "'"
    none = "cast(array() as array<string>)"
    need = NEEDS[kind].format(t=t)
    return (
        f"case when {need} then regexp_extract_all({t}, {p}, 0) else {none} end",
        f"case when {need} then split({t}, {p}, -1) else {none} end",
    )


_LUHN = (
    "(aggregate(sequence(1, length(dg)), 0, (lu, li) -> lu + case when li % 2 = 1 then cast(substring(dg, length(dg) - li + 1, 1) as int)"
    " else cast(substring('0246813579', cast(substring(dg, length(dg) - li + 1, 1) as int) + 1, 1) as int) end) % 10 = 0)"
)


def _valid(kind: str) -> str:
    digits = "regexp_replace(m.v, '[^0-9]', '')"
    if kind == "ip":
        return f"m.v rlike r'^{OCTET}(?:[.]{OCTET}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "card":
        return f"case when length({digits}) between 14 and 19 then exists(array({digits}), dg -> {_LUHN}) else false end"
    return "true"


def free_prefix(docs: DataFrame) -> str:
    """A beginning that no column of the caller has."""
    name = "pii"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "x"
    return name


def candidates(docs: DataFrame, text: str, p: str) -> DataFrame:
    """Add ``<p>_t`` and ``<p>_c_<kind>``: array<struct<s, e, v>> of all candidates, code points, end exclusive."""
    out = docs.withColumn(f"{p}_t", F.coalesce(F.col(text), F.lit("")))
    found = {k: _found(k, f"{p}_t") for k in KINDS}
    out = out.withColumns({f"{p}_m_{k}": F.expr(m) for k, (m, _) in found.items()} | {f"{p}_g_{k}": F.expr(g) for k, (_, g) in found.items()})
    # A match begins after the gaps and matches before it and its own gap.
    out = out.withColumns(
        {f"{p}_l_{k}": F.expr(f"zip_with({p}_m_{k}, slice({p}_g_{k}, 1, size({p}_m_{k})), (m, g) -> cast(length(m) + length(g) as bigint))") for k in KINDS}
    )
    out = out.withColumns({f"{p}_b_{k}": F.expr(_scan(f"{p}_l_{k}", "({a} + {x})", "0L", f"q{i}")) for i, k in enumerate(KINDS)})
    out = out.withColumns(
        {
            f"{p}_c_{k}": F.expr(
                f"transform({p}_m_{k}, (v, i) -> named_struct('s', {p}_b_{k}[i] + length({p}_g_{k}[i]), 'e', {p}_b_{k}[i] + {p}_l_{k}[i], 'v', v))"
            )
            for k in KINDS
        }
    )
    return out.drop(*(f"{p}_{x}_{k}" for x in "mglb" for k in KINDS))


# --- features and trees --------------------------------------------------------
def _count(v: str, kind: str) -> str:
    return f"length(regexp_replace({v}, '[^{kind}]', ''))"


def _check_sql(kind: str) -> str:
    if kind == "iban":
        digit = "case when ch between '0' and '9' then (acc * 10 + cast(ch as int)) % 97 else (acc * 100 + ascii(ch) - 55) % 97 end"
        chars = "split(replace(concat(substring(m.v, 5), substring(m.v, 1, 4)), ' ', ''), '')"
        return f"case when aggregate(filter({chars}, ch -> ch <> ''), 0, (acc, ch) -> {digit}) = 1 then 1.0D else 0.0D end"
    of = "regexp_extract(m.v, '(?s)^[^=:]*[=:](.*)$', 1)" if kind == "secret" else "m.v"
    value = f"case when {of} = '' then m.v else {of} end" if kind == "secret" else "m.v"
    return f"case when {value} rlike r'{CHECKS[kind]}' then 1.0D else 0.0D end" if kind in CHECKS else "0.0D"


def remainder(v: str) -> int:
    """The remainder by 97 of an account number, 1 for a right one."""
    bare = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def _check(kind: str, v: str) -> float:
    if kind == "iban":
        return float(remainder(v) == 1)
    value = (re.search(r"(?s)^[^=:]*[=:](.*)$", v) or [v, v])[1] or v if kind == "secret" else v
    return float(re.search(CHECKS[kind], value) is not None) if kind in CHECKS else 0.0


def feature_sql(kind: str, t: str) -> str:
    """struct of the features of candidate ``m`` (s, e, v); positions are bounded by windows of 24 before and 16 after."""
    before = f"lower(substring({t}, cast(greatest(m.s - 23, 1) as int), cast(least(m.s, 24) as int)))"
    after = f"lower(substring({t}, cast(m.e + 1 as int), 16))"
    return (
        f"named_struct('size', cast(length(m.v) as double), 'digits', {_count('m.v', '0-9')} / cast(length(m.v) as double), "
        f"'uppers', {_count('m.v', 'A-Z')} / cast(length(m.v) as double), 'marks', {_count('m.v', '=:@+()')} * 1.0D, "
        f"'cue', case when concat({before}, lower(m.v)) rlike '{CUES}' then 1.0D else 0.0D end, "
        f"'against', case when concat({before}, '|', {after}) rlike '{AGAINST}' then 1.0D else 0.0D end, "
        f"'edge', case when substring({t}, cast(m.e + 1 as int), 1) rlike '[A-Za-z0-9]' then 1.0D else 0.0D end, "
        f"'runs', {_count('regexp_replace(m.v, r' + chr(39) + '[0-9]+' + chr(39) + ', ' + chr(39) + '#' + chr(39) + ')', '#')} * 1.0D, "
        f"'check', {_check_sql(kind)}, 'kind', {float(KINDS.index(kind))}D)"
    )


def features(kind: str, before: str, v: str, after: str) -> list[float]:
    """The same for one written sentence."""
    share = lambda chars: sum(c in chars for c in v) / len(v)
    cue = re.search(CUES, (before[-24:] + v).lower()) is not None
    against = re.search(AGAINST, f"{before[-24:]}|{after[:16]}".lower()) is not None
    edge = re.match("[A-Za-z0-9]", after) is not None
    return [
        float(len(v)), share("0123456789"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), float(sum(c in "=:@+()" for c in v)),
        float(cue), float(against), float(edge), float(len(re.findall("[0-9]+", v))), _check(kind, v), float(KINDS.index(kind)),
    ]


FILLER = "the a we can then see new old plan city water first later order page line of and with part table green".split()
# What stands before a real value of a kind, and before a look-alike.
REAL_LEADS = {
    "secret": ("", "set ", "use ", "export "),
    "local_phone": ("call me at ", "tel. ", "phone: ", "mobile phone ", "fax ", "contact us: ", "my number: ", ""),
    "national_id": ("ssn ", "social security number ", "tax id ", "my id: ", "id card ", "number "),
    "iban": ("iban ", "bank account ", "account: ", "pay to ", ""),
    "spelled_email": ("mail ", "email: ", "write to ", "contact ", ""),
}
FALSE_LEADS = {
    "secret": ("", "the ", "our ", "see "),
    "local_phone": ("version ", "lot ", "order no. ", "model ", "ratio ", "page ", ""),
    "national_id": ("order ", "score ", "lot ", "in the years ", "serial ", ""),
    "iban": ("part ", "model ", "code ", "batch ", "error code ", "serial ", "account ", "the ", ""),
    "spelled_email": ("look ", "meet ", "they were ", "room ", ""),
}
# What may follow a look-alike.
FALSE_ENDS = (" in stock", " pages", " of the model", ". ", " and ", ", ")


def _account(of, digit: str, upper: str, right: bool) -> str:
    """An account number with right or wrong check digits, in groups of four or not."""
    land, body = of(upper, 2), of(digit, 14, 20) if right or of(digit, 1) < "6" else of(upper + digit, 12, 20)
    body = of(upper, 4) + body[4:] if of(digit, 1) < "4" else body
    check = next(f"{k:02d}" for k in range(2, 99) if remainder(f"{land}{k:02d}{body}") == 1)
    if not right:
        check = f"{(int(check) + int(of(digit, 1)) + 1) % 97 + 2:02d}"
    v = land + check + body
    return " ".join(v[i : i + 4] for i in range(0, len(v), 4)) if of(digit, 1) < "5" else v


def _draw(r: random.Random) -> tuple[list[float], int]:
    """One written candidate: the features of a real one (1) or of a look-alike (0)."""
    kind, real = r.choice(ADDED), r.random() < 0.5
    of = lambda chars, lo, hi=None: "".join(r.choice(chars) for _ in range(r.randint(lo, hi or lo)))
    digit, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if kind == "secret":
        name = r.choice(("password", "passwd", "secret", "token", "api_key", "apikey"))
        sep = r.choice(("=", ": ", " = ", "=\"", ":"))
        v = name + sep + (of(digit + lower[:6], 12, 48) if r.random() < 0.6 else of(digit + lower + upper + "_-", 12, 48))
        if real and r.random() < 0.4:
            v = r.choice(("AKIA", "ghp_", "sk-", "xoxb-")) + of(upper + digit + (lower if r.random() < 0.6 else ""), 16, 48)
        elif real and r.random() < 0.2:
            v = name + sep + of(lower if r.random() < 0.5 else lower + upper, 20, 300)
        if not real:
            v = name + r.choice((": ", "=")) + (of(lower, 8, 14) if r.random() < 0.8 else of(lower, 4, 8) + r.choice("-_./") + of(lower, 4, 8))
    elif kind == "local_phone":
        first = digit[2:] if real or r.random() < 0.6 else digit
        a, b, c = of(first, 1) + of(digit, 2), of(first, 1) + of(digit, 2), of(digit, 4)
        v = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))
    elif kind == "national_id":
        v = f"{of(digit[1:9] if real else digit, 1)}{of(digit, 2)}-{of(digit, 1)}{of(digit[1:] if real else digit, 1)}-{of(digit, 3)}{of(digit[1:] if real else digit, 1)}"
    elif kind == "iban":
        v = _account(of, digit, upper, real and r.random() < 0.97)
    else:
        v = f"{of(lower, 3, 10)} [at] {of(lower, 4, 10)} [dot] {r.choice(('com', 'org', 'net', 'de'))}" if real else f"{of(lower, 2, 5)} (at) {of(lower, 3, 8)}. {of(lower, 2, 9)}"
        if real and r.random() < 0.4:
            v = f"{of(lower, 3, 10)}(at){of(lower, 4, 10)}.{r.choice(('com', 'org', 'net', 'de'))}"
    words = " ".join(r.choice(FILLER) for _ in range(r.randint(0, 5)))
    before = f"{words} {r.choice((REAL_LEADS if real else FALSE_LEADS)[kind])}"
    glued = r.random() < (0.02 if real else 0.2)
    end = r.choice(FALSE_ENDS if not real and r.random() < 0.5 else (" ", ". ", ", ", "; "))
    return features(kind, before, v, "x" if glued else end + r.choice(FILLER)), int(real)


def _stump(rows: list[list[float]], grad: list[float], hess: list[float], index: list[int]):
    """The best split of the rows at ``index``: (gain, feature, cut, left rows, right rows)."""
    best = None
    g_all, h_all = sum(grad[i] for i in index), sum(hess[i] for i in index)
    for f in range(len(FEATURES)):
        order = sorted(index, key=lambda i: rows[i][f])
        g = h = 0.0
        for a, b in zip(order, order[1:]):
            g += grad[a]
            h += hess[a]
            if rows[a][f] == rows[b][f]:
                continue
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, (rows[a][f] + rows[b][f]) / 2)
    if best is None or best[0] < 1e-6:
        return None
    _, f, cut = best
    return f, cut, [i for i in index if rows[i][f] <= cut], [i for i in index if rows[i][f] > cut]


@functools.cache
def model(trees: int = 20, rate: float = 0.3, seed: int = 7) -> tuple[tuple, float, float, dict[str, float]]:
    """Boosted depth-3 trees, the two numbers of the calibrating curve and a threshold for each added kind.

    Half of the sample grows the trees; the other half fits the curve and gives, for
    each kind, the lowest threshold at which nine of ten selected candidates are real,
    half way to the next candidate, and ``FLOOR`` at least.
    """
    r = random.Random(seed)
    rows, y = map(list, zip(*(_draw(r) for _ in range(SAMPLE))))
    half = SAMPLE // 2
    score = [0.0] * SAMPLE
    grown = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score[:half]]
        grad = [y[i] - p[i] for i in range(half)]
        hess = [q * (1 - q) for q in p]

        def leaf(index):
            return rate * sum(grad[i] for i in index) / (sum(hess[i] for i in index) + 1) if index else 0.0

        def grow(index, depth):
            cut = _stump(rows, grad, hess, index) if depth else None
            if cut is None:
                return leaf(index)
            f, at, left, right = cut
            return (f, at, grow(left, depth - 1), grow(right, depth - 1))

        tree = grow(list(range(half)), 3)
        grown.append(tree)
        score = [s + _walk(tree, x) for s, x in zip(score, rows)]
    a, b = 1.0, 0.0
    for _ in range(200):
        ga = gb = 0.0
        for s, t in zip(score[half:], y[half:]):
            e = t - 1 / (1 + math.exp(-(a * s + b)))
            ga += e * s
            gb += e
        a, b = a + 0.5 * ga / half, b + 0.5 * gb / half
    thresholds = {}
    for k in ADDED:
        own = [i for i in range(half, SAMPLE) if rows[i][-1] == KINDS.index(k)]
        held = sorted(((1 / (1 + math.exp(-(a * score[i] + b))), y[i]) for i in own), reverse=True)
        right, thresholds[k] = 0, 1.0
        for n, (p, t) in enumerate(held, 1):
            right += t
            below = held[n][0] if n < len(held) else 0.0
            if below < p and right >= 0.9 * n:  # candidates of one score stand or fall together
                thresholds[k] = max(FLOOR, (p + below) / 2)
    return tuple(grown), a, b, thresholds


def _walk(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_sql(tree, f: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    k, cut, left, right = tree
    return f"case when {f}.{FEATURES[k]} <= {cut!r}D then {_tree_sql(left, f)} else {_tree_sql(right, f)} end"


def score_sql(f: str) -> str:
    """The calibrated score of feature struct ``f``."""
    trees, a, b, _ = model()
    total = " + ".join(f"({_tree_sql(t, f)})" for t in trees)
    return f"1.0D / (1.0D + exp(-({a!r}D * ({total}) + {b!r}D)))"


def detect(docs: DataFrame, text: str, p: str) -> DataFrame:
    """Add ``<p>_t``, ``<p>_base`` and ``<p>_spans``: array<struct<s, o, e, kind>> ordered by start, then kind.

    A null text counts as empty and has none. Spans that the trees select and that
    overlap become one, from the first start to the last end, of the kind with the
    highest score; such a span is left out if a base span covers it. Base spans stay
    as they are, so spans of a base kind may overlap others.
    """
    thresholds = model()[3]
    out = candidates(docs, text, p)
    base = [
        f"transform(filter({p}_c_{k}, m -> {_valid(k)}), m -> named_struct('s', m.s, 'o', {KINDS.index(k)}, 'e', m.e, 'kind', '{k}'))" for k in BASE
    ]
    out = out.withColumn(f"{p}_base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    more = [
        f"filter(transform({p}_c_{k}, m -> named_struct('s', m.s, 'o', {KINDS.index(k)}, 'e', m.e, 'kind', '{k}', "
        f"'score', element_at(transform(array({feature_sql(k, f'{p}_t')}), ft -> {score_sql('ft')}), 1))), m -> m.score >= {thresholds[k]!r}D)"
        for k in ADDED
    ]
    out = out.withColumn(f"{p}_more", F.expr(f"array_sort(concat({', '.join(more)}))"))
    # A span begins a new run of overlapping ones if no earlier span ends after its start.
    out = out.withColumn(f"{p}_upto", F.expr(_scan(f"transform({p}_more, x -> x.e)", "greatest({a}, {x})", "0L", "r")))
    out = out.withColumn(
        f"{p}_runs", F.expr(f"filter(transform({p}_more, (x, i) -> case when x.s >= {p}_upto[i] then i + 1 else 0 end), i -> i > 0)")
    )
    run = f"slice({p}_more, i, coalesce(get({p}_runs, k + 1), size({p}_more) + 1) - i)"
    best = f"array_max(transform({run}, x -> named_struct('score', x.score, 's', -x.s, 'o', -x.o, 'kind', x.kind)))"
    joined_run = f"named_struct('s', {p}_more[i - 1].s, 'o', -{best}.o, 'e', array_max(transform({run}, x -> x.e)), 'kind', {best}.kind)"
    out = out.withColumn(f"{p}_more", F.expr(f"transform({p}_runs, (i, k) -> {joined_run})"))
    # Both kinds of spans by start, base first: the largest end of a base span before an added one tells whether it is covered.
    both = f"array_sort(concat(transform({p}_base, x -> named_struct('s', x.s, 'w', 0, 'x', x)), transform({p}_more, x -> named_struct('s', x.s, 'w', 1, 'x', x))))"
    out = out.withColumn(f"{p}_both", F.expr(both))
    out = out.withColumn(f"{p}_upto", F.expr(_scan(f"transform({p}_both, y -> case when y.w = 0 then y.x.e else 0L end)", "greatest({a}, {x})", "0L", "r")))
    kept = f"filter({p}_both, (y, i) -> y.w = 0 or {p}_upto[i] < y.x.e)"
    out = out.withColumn(f"{p}_spans", F.expr(f"case when size({p}_more) = 0 then {p}_base else array_sort(transform({kept}, y -> y.x)) end"))
    return out.drop(*(f"{p}_{x}" for x in ("more", "upto", "runs", "both")), *(f"{p}_c_{k}" for k in KINDS))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, cast(x.s as string), cast(x.e as string))), ',')")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row; a null id stays null."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = detect(src, "text", "pii")
    counts = [F.expr(f"cast(size(filter(pii_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined("pii_base").cast("binary"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[KIND]``; overlapping spans become one.

    A null text stays null; the columns and rows are those of ``docs``, whatever their names.
    """
    p = free_prefix(docs)
    out = detect(docs, text, p).withColumn(f"{p}_ends", F.expr(f"transform({p}_spans, x -> x.e)"))
    out = out.withColumn(f"{p}_upto", F.expr(_scan(f"{p}_ends", "greatest({a}, {x})", "0L", "w")))
    gap = f"substring({p}_t, cast({p}_upto[i] + 1 as int), cast(greatest(x.s - {p}_upto[i], 0L) as int))"
    mark = f"case when x.s >= {p}_upto[i] then concat('[', upper(x.kind), ']') else '' end"
    body = f"array_join(transform({p}_spans, (x, i) -> concat({gap}, {mark})), '')"
    tail = f"substring({p}_t, cast(array_max({p}_ends) + 1 as int))"
    fixed = F.expr(f"case when size({p}_spans) = 0 then `{text}` else concat({body}, {tail}) end")
    return out.withColumn(text, fixed).select(*docs.columns)
