"""Personal data by weak supervision: native SQL expressions, a tiny model fitted on counts of vote patterns.

Candidates are all that the base patterns match, whether or not a match passes their check, and what looser patterns
find: national numbers, bank accounts, phones without a plus, spelt-out addresses, long random words that may be
secrets. Three labelers look at each candidate, whatever found it, and vote 1, -1 or 0 (no opinion): `regex` judges its
written form and checksum, `gazetteer` looks its parts up in lists (top-level domains, calling codes, issuers, countries,
reserved ranges, token lengths), `context` reads the 40 characters before it for cue and counter-cue words.
Expectation-maximisation over the counts of distinct (kind, length class, votes) patterns - at most 7 * 3 * 27 rows,
whatever the input - estimates each kind's share and how reliable each labeler is, without being told which candidates
are base spans; a logistic span classifier is then fitted to the resulting soft labels. Base spans always stay; another
candidate becomes a span if the classifier gives it at least half and it overlaps no base span. Of candidates inside a
base span nothing is learned.

A text is scanned in one pass per pattern: \\G ties each match to the one before, so nothing is scanned twice, and
possessive groups keep the matcher off the stack on very long texts. Rows are judged alone; only the pattern counts
are shuffled, pre-aggregated.

Defined results: null and empty texts give zero counts, an empty spans string and the hash of the empty string;
repeated rows repeat and count as often in the model; an empty table gives no rows and a model of prior values;
columns besides doc_id and text are ignored (redact keeps them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import placed, stored, texts

#: Base kinds in the order in which ties are listed, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")
#: The base patterns. Group 1 is what lies between, group 2 the match; a start is \\G or follows a character outside the first class.
PATTERNS = {
    "email": r"\G((?s:.*?[^A-Za-z0-9._%+-])??)([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"\G((?s:.*?[^0-9])??)([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    "card": r"\G((?s:.*?[^0-9])??)([0-9](?:[\x20-]?[0-9])++)",
    "phone": r"\G((?s:.*?))(\+[0-9][\x20().0-9-]+[0-9])",
}
GATES = {
    "email": "contains(text, '@')", "ip": r"text rlike r'[0-9]\.[0-9]+\.[0-9]'",
    "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){11}'", "phone": "contains(text, '+')",
}
LOOSE = (
    r"\G((?s:.*?))((?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,4}+"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_-]{0,128}[0-9])(?=[0-9_-]{0,128}[A-Za-z])[A-Za-z0-9_-]{20,128}+(?![+/=]))"
)
LOOSE_GATE = r"text rlike r'[0-9]{3}[-. )]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[\[(] ?at ?[\])]|(?=[A-Za-z_-]{0,19}[0-9])[A-Za-z0-9_-]{20}'"
#: Gazetteers and cue words.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "cloud", "online", "shop", "site", "store", "tech", "xyz", "co", "me", "tv", "cc",
    "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "is", "it", "jp", "kr", "lt", "lu",
    "lv", "mx", "my", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk", "th", "tr", "tw", "ua", "uk", "us", "ve", "vn", "za",
)
#: Calling codes: one digit, two digits, and whole ranges of three digits, as they are dealt out by zone.
CALLING_CODES = "1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9])"
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
CUES = {
    "email": "mail|contact|write to|courriel|correo", "ip": r"\bip\b|address|host|server|adresse", "card": "card|visa|master|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|call|fax|mobile|telefon|appel|tel[eé]fono", "ssn": r"\bssn\b|social security", "iban": r"iban|account|konto|compte|cuenta",
    "secret": r"token|passw|secret|api.?key|access.?key|private.?key|bearer|credential|auth",
}
COUNTER_CUES = r"version|\bisbn|\border\b|invoice|serial|release|commit|checksum|digest|revision|\bsha[0-9]|\bmd5"
CAND = "struct<kind:string,start:int,end:int,base:boolean,v_regex:int,v_gazetteer:int,v_context:int,len_class:int>"


def _matches(pattern: str, gate: str) -> str:
    """Matches of a pattern as array<struct<start,end,hit,before>>; empty where the gate does not hold."""
    rx = pattern.replace("'", "\\'")
    found = f"zip_with(regexp_extract_all(text, r'{rx}', 1), regexp_extract_all(text, r'{rx}', 2), (a, b) -> named_struct('pre', a, 'hit', b))"
    none = "CAST(array() AS array<struct<start:int,end:int,hit:string,before:string>>)"
    return f"IF({gate}, {placed(found, {'hit': 'x.hit', 'before': 'lower(right(x.pre, 40))'})}, {none})"


def _luhn(hit: str) -> str:
    d = f"reverse(regexp_replace({hit}, '[^0-9]', ''))"
    return f"""(aggregate(sequence(1, length({d})), 0, (s, i) -> s + IF(i % 2 = 1, int(substring({d}, i, 1)),
      IF(int(substring({d}, i, 1)) > 4, 2 * int(substring({d}, i, 1)) - 9, 2 * int(substring({d}, i, 1))))) % 10 = 0)"""


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _digits(hit: str) -> str:
    return f"length(regexp_replace({hit}, '[^0-9]', ''))"


def _mod97(hit: str) -> str:
    """The account number's check: first four characters moved to the end, letters as 10 to 35, the rest of division by 97."""
    c = f"replace(upper({hit}), ' ', '')"
    digits = f"concat(substring({c}, 5), left({c}, 4))"
    value = f"IF(substring(t, i, 1) BETWEEN '0' AND '9', int(substring(t, i, 1)), ascii(substring(t, i, 1)) - 55)"
    step = f"IF(substring(t, i, 1) BETWEEN '0' AND '9', s * 10 + {value}, s * 100 + {value}) % 97"
    return f"(element_at(transform(array({digits}), t -> aggregate(sequence(1, length(t)), 0, (s, i) -> CAST({step} AS INT))), 1) = 1)"


VALID = {
    "email": "true",
    "ip": r"x.hit rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$'",
    "card": f"({_digits('x.hit')} BETWEEN 12 AND 19 AND {_luhn('x.hit')})",
    "phone": f"({_digits('x.hit')} BETWEEN 9 AND 15)",
}
#: How a candidate is written, whatever found it: 1 for the usual form, -1 for one that cannot be, 0 for neither.
FORM = {
    "email": r"IF(x.hit rlike r'\.\.|^[.]|[.]@|@-|[0-9]$', -1, IF(x.hit rlike r'[\[(]', 0, 1))",
    "ip": f"IF(NOT ({VALID['ip']}), -1, IF(x.hit rlike r'(?:^|\\.)0[0-9]', 0, 1))",
    "card": f"IF(NOT {VALID['card']}, -1, IF(x.hit rlike r'^(?:[0-9]{{12,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{2}}[ -][0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$', 1, 0))",
    "phone": rf"IF({_digits('x.hit')} NOT BETWEEN 7 AND 15 OR x.hit rlike r'[ .()-]{{3}}|[.-][.-]', -1, IF(x.hit rlike r'^\+?[0-9]{{0,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{2,4}}$', 1, 0))",
    "ssn": "IF(x.hit rlike '^(?:000|666|9)|-00-|-0000$', -1, 1)",
    "iban": f"IF({_mod97('x.hit')}, 1, -1)",
    "secret": "IF(x.hit rlike '^[0-9a-f]+$|^[0-9A-F]+$|[a-z][0-9A-Z]*[A-Z0-9][a-z0-9]*[A-Z]', 1, IF(x.hit rlike '^[A-Za-z]+(?:[-_][A-Za-z]+)+[-_]?[0-9]{1,4}$|[-_]{2}', -1, 0))",
}
#: Whether lists know its parts.
LISTED = {
    "email": f"IF(lower(substring_index(x.hit, '.', -1)) IN ({_quoted(TLDS)}), 1, -1)",
    "ip": r"IF(x.hit rlike r'^0*(?:0|127|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})\.', -1, IF(x.hit rlike r'^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.', 0, 1))",
    "card": "IF(x.hit rlike '^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0245])', 1, -1)",
    "phone": f"IF(x.hit rlike r'^\\+(?:{CALLING_CODES})', 1, IF(x.hit rlike r'^\\+', -1, IF(x.hit rlike r'^\\(?[2-9][0-8][0-9]\\)?[ .-][2-9]', 1, -1)))",
    "ssn": "IF(x.hit rlike '^(?:078-05-1120|219-09-9999|123-45-6789)$', -1, 0)",
    "iban": "IF(length(replace(x.hit, ' ', '')) = coalesce(element_at(map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + "), left(x.hit, 2)), 0), 1, -1)",
    "secret": "IF(x.hit rlike '^(?:sk|pk|ghp|gho|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ)', 1, IF(x.hit rlike '^[0-9a-fA-F]+$' AND length(x.hit) IN (32, 40, 48, 64, 96, 128), 1, -1))",
}


def _votes(kind: str, base: str) -> str:
    return f"""named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'base', {base}, 'v_regex', {FORM[kind]}, 'v_gazetteer', {LISTED[kind]},
      'v_context', IF(x.before rlike r'(?:{CUES[kind]})[^a-z]*[a-z]*[^a-z]*$', 1, IF(x.before rlike r'(?:{COUNTER_CUES})[^a-z]*$', -1, IF(x.before rlike r'{CUES[kind]}', 1, 0))),
      'len_class', IF(length(x.hit) < 12, 0, IF(length(x.hit) < 20, 1, 2)))"""


def candidates(d: DataFrame) -> DataFrame:
    """d (with a column text, not null) and `cands`: array of candidate spans in code points, with their votes."""
    # a failing match with the digits of no card or phone at all is no candidate
    near = {"card": f"{_digits('x.hit')} BETWEEN 12 AND 19", "phone": f"{_digits('x.hit')} BETWEEN 7 AND 17"}
    found = {k: _matches(PATTERNS[k], GATES[k]) for k in BASE_KINDS}
    found |= {k: f"filter({found[k]}, x -> {p})" for k, p in near.items()}
    parts = [f"transform({found[k]}, x -> {_votes(k, VALID[k])})" for k in BASE_KINDS]
    loose = f"""transform({_matches(LOOSE, LOOSE_GATE)}, x -> CASE
      WHEN x.hit rlike r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {_votes('ssn', 'false')}
      WHEN x.hit rlike r'[\\[(] ?at ?[\\])]' THEN {_votes('email', 'false')}
      WHEN x.hit rlike r'^\\(?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' THEN {_votes('phone', 'false')}
      WHEN x.hit rlike r'^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?$' THEN {_votes('iban', 'false')}
      ELSE {_votes('secret', 'false')} END)"""
    d = d.withColumn("cands", F.expr(f"cast(concat({', '.join(parts)}, {loose}) AS array<{CAND}>)"))
    # what lies in a base span is that span's, not a candidate of its own
    inside = "NOT x.base AND exists(filter(cands, b -> b.base), b -> b.start < x.end AND x.start < b.end)"
    return d.withColumn("cands", F.expr(f"IF(size(cands) < 2, cands, filter(cands, x -> NOT ({inside})))"))


@dataclass
class SpanModel:
    """Labeler reliabilities from EM and the weights of the final classifier."""

    prior: dict = field(default_factory=dict)  # kind -> share of personal data
    reliability: dict = field(default_factory=dict)  # labeler -> {class: {vote: probability}}
    weights: dict = field(default_factory=dict)  # feature -> weight

    def logit(self, x: str = "x") -> str:
        """The classifier's SQL expression over a candidate struct."""
        terms = [repr(self.weights.get("bias", 0.0)) + "D"]
        for f, w in sorted(self.weights.items()):
            if f != "bias":
                name, value = f.split("=")
                terms.append(f"IF({x}.{name} = " + (f"'{value}'" if name == "kind" else value) + f", {w!r}D, 0.0D)")
        return "(" + " + ".join(terms) + ")"


LABELERS = ("v_regex", "v_gazetteer", "v_context")


def _features(row) -> list[str]:
    return ["bias", f"kind={row['kind']}", f"len_class={row['len_class']}", *(f"{v}={row[v]}" for v in LABELERS if row[v])]


#: What is believed of a labeler before any data, worth two candidates: how often its vote is right. A vote of 0 says nothing.
BELIEF = {"v_regex": 0.9, "v_gazetteer": 0.85, "v_context": 0.9}


def fit_span_model(with_cands: DataFrame, rounds: int = 50, steps: int = 400) -> SpanModel:
    """EM and logistic fit over pattern counts. The rows sent to the driver are bounded by the number of patterns (567)."""
    # the outer form, as the plain one would look for candidates once more, to leave out rows that have none
    c = with_cands.select(F.explode_outer("cands").alias("x")).where("x IS NOT NULL").groupBy("x.kind", "x.len_class", *(f"x.{v}" for v in LABELERS)).count()
    return fit_patterns(sorted((r.asDict() for r in c.collect()), key=str), rounds, steps)


def fit_patterns(rows: list[dict], rounds: int = 50, steps: int = 400) -> SpanModel:
    """The model of given vote patterns: dicts of kind, len_class, the three votes and count."""
    rel = {v: {1: {1: p, -1: 1 - p, 0: 1.0}, 0: {-1: p, 1: 1 - p, 0: 1.0}} for v, p in BELIEF.items()}
    weights = {"bias": -1.0, "v_regex=1": 1.0, "v_regex=-1": -2.0, "v_gazetteer=1": 1.0, "v_gazetteer=-1": -1.5, "v_context=1": 2.0, "v_context=-1": -2.0}
    model = SpanModel({k: 0.5 for k in KINDS}, rel, weights)
    total = sum(r["count"] for r in rows)
    if not total:
        return model
    for _ in range(rounds):
        for r in rows:
            a = model.prior[r["kind"]] * math.prod(rel[v][1][r[v]] for v in LABELERS)
            b = (1 - model.prior[r["kind"]]) * math.prod(rel[v][0][r[v]] for v in LABELERS)
            r["p"] = a / (a + b)
        for k in KINDS:  # shares are drawn towards a half by two candidates
            mine = [r for r in rows if r["kind"] == k]
            model.prior[k] = (1 + sum(r["p"] * r["count"] for r in mine)) / (2 + sum(r["count"] for r in mine))
        for v in LABELERS:
            for k in (1, 0):
                right = 1 if k else -1
                mass = {right: 2.0 * BELIEF[v], -right: 2.0 * (1 - BELIEF[v])}
                for r in rows:
                    if r[v]:
                        mass[r[v]] += r["count"] * (r["p"] if k else 1 - r["p"])
                rel[v][k] = {x: m / sum(mass.values()) for x, m in mass.items()} | {0: 1.0}
    weights = dict(weights)
    for _ in range(steps):
        grad: dict[str, float] = {}
        for r in rows:
            z = sum(weights.get(f, 0.0) for f in _features(r))
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - r["p"]) * r["count"] / total
            for f in _features(r):
                grad[f] = grad.get(f, 0.0) + err
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) - 1.0 * (g + 0.001 * weights.get(f, 0.0))
    model.weights = {f: round(w, 6) for f, w in weights.items()}
    return model


def label_spans(with_cands: DataFrame, model: SpanModel) -> DataFrame:
    """with_cands plus `spans`: sorted array<struct<start,rank,end,kind,base>> of base spans and accepted candidates."""
    rank = f"array_position(array({_quoted(KINDS)}), x.kind)"
    base = "filter(cands, x -> x.base)"
    more = f"filter(cands, x -> NOT x.base AND {model.logit()} >= 0)"
    d = with_cands.withColumn("_base", F.expr(base))
    return d.withColumn("spans", F.expr(f"""sort_array(transform(concat(_base, {more}),
        x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', x.kind, 'base', x.base)))""")).drop("_base", "cands")  # fmt: skip


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: model fitted on these documents' candidates."""
    c = stored(candidates(texts(docs)).drop("text"), "pii-candidates")
    d = label_spans(c, fit_span_model(c))
    base = "filter(spans, x -> x.base)"
    return d.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span's characters replaced by [KIND]; of overlapping spans the union goes, named by the first."""
    c = candidates(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    d = label_spans(c, fit_span_model(c))  # looking twice costs less than writing all rows in between
    # what is kept is the text from each span's end to the next one's start, put together in runs of spans, each on its own
    # piece of the text: a substring is found by counting characters from the start of what it is cut from
    run = "greatest(16, CAST(ceil(sqrt(size(spans))) AS INT))"
    runs = f"transform(sequence(0, (greatest(size(spans), 1) - 1) div {run}), k -> slice(spans, CAST(k * {run} AS INT) + 1, {run}))"
    none = "cast(array() AS array<string>)"
    inner = f"""aggregate(r, named_struct('at', s.at, 'out', {none}), (u, x) -> IF(x.end <= u.at, u, named_struct('at', x.end, 'out', concat(u.out,
      IF(x.start >= u.at, array(substring(piece, u.at - s.at + 1, x.start - u.at), concat('[', upper(x.kind), ']')), {none})))),
      u -> named_struct('at', u.at, 'out', concat(s.out, array(array_join(u.out, '')))))"""
    piece = "substring(text, s.at + 1, greatest(array_max(transform(r, x -> x.end)) - s.at, 0))"
    cut = f"""aggregate({runs}, named_struct('at', 0, 'out', {none}), (s, r) -> element_at(transform(array({piece}), piece -> {inner}), 1),
      s -> concat(array_join(s.out, ''), substring(text, s.at + 1)))"""
    d = d.withColumn("text", F.expr(f"IF(size(spans) = 0, text, {cut})"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return d.select(*((new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
