"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the base spans (strict patterns with checks) and looser ones that touch no base span: written-out
e-mail addresses, national phone numbers, IPv6 addresses, titled names. Labelers vote +1, -1 or 0 on each: format
(regex), gazetteer (top-level domains, dial codes, given names) and context (words before it, its edges).
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability by kind; its
posteriors are the soft labels of a final span classifier (naive Bayes over a span's shape, edges, form, context and
gazetteer), whose weights are grouped sums. A looser span stays if the classifier gives it 0.5 or more; base spans always stay.

Only counts by vote pattern and sums by feature value leave the rows: at most kinds x 3 ** labelers and kinds x
features x values of them. Positions are code points; patterns are linear in the text (possessive, and anchored so
that a run is entered once).

Cases: null text counts as empty and has no spans; equal texts and repeated rows get equal results; an empty
table gives an empty result (and a model without weights); of the documents' columns all but ``base`` and ``loose``
(from candidates) or ``base`` and ``spans`` (from annotate) may be kept; with ``into`` both work inside one struct of
that name, and every column may. A text of very many matches costs their number times its square root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import tables

#: Kinds in their order.
KINDS = ["email", "ip", "card", "phone", "name"]
#: Base patterns, linear forms of the contract's. A run of characters is entered at its start or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: IPv6: eight groups, or fewer around one ``::`` (at least one group, so that a bare ``::`` is none).
_GROUP = "[0-9A-Fa-f]{1,4}"
_SHORT = "|".join([rf":(?::{_GROUP}){{1,7}}", *[rf"(?:{_GROUP}:){{1,{k}}}(?::{_GROUP}){{1,{7 - k}}}" for k in range(1, 7)], rf"(?:{_GROUP}:){{1,7}}:"])
#: Looser patterns of the method.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": rf"(?<![0-9A-Fa-f:])(?:{_GROUP}:){{7}}{_GROUP}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z_:])(?:{_SHORT})(?![0-9A-Za-z_]|:[0-9A-Za-z_:])",
    "phone": r"(?<![0-9+(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sr|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: Texts without a match of this can't hold the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca"]
DIAL_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91"]
GIVEN_NAMES = ["Anna", "Carlos", "Claire", "David", "Emma", "Hans", "James", "Jean", "John", "José", "Julia", "Karl", "Laura", "Lucas", "Maria", "Marie", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Thomas", "William"]
#: Words before a span that speak for and against it.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|handy|appel|llam)\w*\W*(?:\w+\W+){0,2}$",
    "name": r"(?i)(?:dear|by|from|with|for)\W*$",
}
AGAINST = r"(?i)(?:version|\bv|isbn|issn|order|invoice|serial|section|chapter|doi|part)\W*$"
#: Form, shape, gazetteer, words before the span, edges.
LABELERS, NEAR, EDGES = 5, 3, 4
#: Weight of a labeler's starting reliability, as a share of the kind's spans, and the share of candidates that is taken to
#: be personal data: votes alone can't tell the classes where hardly a candidate is wrong.
ANCHOR, BALANCE = 0.3, 0.7
BEFORE = 40


def running(lengths: Column) -> Column:
    """Sum of all lengths before each one, in groups of square-root size."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(b: Column) -> Column:
        group = b["group"]
        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(b["all"]) / group).cast("int") - 1), lambda g: F.slice(b["all"], g * group + 1, group))
        held = F.array(F.struct(groups.alias("groups"), F.transform(groups, add).alias("totals")))
        return F.flatten(F.transform(held, lambda h: F.flatten(F.transform(h["groups"], lambda part, g: F.transform(part, lambda _, i: add(F.slice(h["totals"], F.lit(1), g)) + add(F.slice(part, F.lit(1), i)))))))

    # the array and its group size are bound once
    bound = F.array(F.struct(lengths.alias("all"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int")).alias("group")))
    return F.when(F.size(lengths) > 0, F.flatten(F.transform(bound, summed))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: str, form: str) -> Column:
    """Leftmost matches that don't overlap: array of (kind, form, start, end, found, before, after)."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("found"), F.slice(pieces, F.lit(2), F.size(found)).alias("rest"))
    # bind the arrays once
    bound = F.transform(F.array(rows), lambda r: F.struct(r.alias("rows"), running(F.transform(r, lambda x: F.char_length(x["piece"]) + F.char_length(x["found"]))).alias("at")))[0]

    def spans(b: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(b["at"], i) + F.char_length(x["piece"])
            return F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"), start.alias("start"), (start + F.char_length(x["found"])).alias("end"), x["found"].alias("found"), F.right(x["piece"], F.lit(BEFORE)).alias("before"), F.left(x["rest"], F.lit(1)).alias("after"))

        return F.transform(b["rows"], lambda x, i: span(x, i))

    return F.transform(F.array(bound), spans)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes_luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_check(kind: str, found: Column) -> Column:
    size = F.char_length(_digits(found))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((size >= 12) & (size <= 19), _passes_luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return (size >= 9) & (size <= 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: base_check(kind, x["found"])


NONE = "array<struct<kind: string, form: string, start: int, end: int, found: string, before: string, after: string>>"


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """The named columns (all by default), with ``base`` and ``loose`` spans, or with a struct of them."""
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c.lower() not in ({into.lower()} if into else {"base", "loose"})]
    held = tables.fresh(docs, "text")
    text = F.coalesce(F.col(held), F.lit(""))
    numbers = text.rlike("[0-9]{3}")
    base, loose = [], []
    for kind, pattern in BASE.items():
        some = F.filter(matches(text, pattern, kind, "base"), _checked(kind))
        has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")
        base.append(F.when(has, some).otherwise(F.array().cast(NONE)))
    has = {"email": text.rlike(r"[(\[]at[)\]]"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]"), "phone": numbers, "name": text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sr|Sra)\.? \p{Lu}")}
    loose = [F.when(has[kind], matches(text, pattern, kind, "loose")).otherwise(F.array().cast(NONE)) for kind, pattern in LOOSE.items()]
    kept = [F.col(f"`{c}`") for c in keep]
    spans = F.struct(F.concat(*base).alias("base"), F.concat(*loose).alias("loose")).alias(held)
    found = docs.select(*kept, F.col(text_col).alias(held)).select(*kept, spans)
    free = F.filter(F.col(held)["loose"], lambda x: ~F.exists(F.col(held)["base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = [F.col(held)["base"].alias("base"), free.alias("loose")]
    return found.select(*kept, *([F.struct(*out).alias(into)] if into else out))


def _domain(found: Column) -> Column:
    return F.lower(F.regexp_extract(found, r"([A-Za-z]+)[^A-Za-z]*$", 1))


def _listed(x: Column) -> Column:
    """1 if a gazetteer has the span's domain, dial code or given name."""
    kind, found = x["kind"], x["found"]
    code = F.regexp_extract(found, r"^\+([0-9]{1,2})", 1)
    name = F.regexp_extract(found, r"^\w+\.? (\p{Lu}\p{Ll}+)", 1)
    has = F.when(kind == "email", _domain(found).isin(DOMAINS)).when(kind == "phone", code.isin(DIAL_CODES) | F.left(code, F.lit(1)).isin(DIAL_CODES)).when(kind == "name", name.isin(GIVEN_NAMES)).otherwise(False)
    return F.when(has, 1).otherwise(0)


def _near(x: Column) -> Column:
    """1 if the words before the span speak for its kind, -1 if they speak against it."""
    found = F.when(x["before"].rlike(AGAINST), -1)
    return reduce(lambda c, k: c.when((x["kind"] == k) & x["before"].rlike(CONTEXT[k]), 1), KINDS, found).otherwise(0)


def votes(x: Column) -> Column:
    """-1, 0 or 1 of each labeler on a span."""
    kind, found = x["kind"], x["found"]
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    size = F.char_length(_digits(found))
    is_ = lambda k: kind == k
    domain = _domain(found)
    shape = F.when(is_("email"), vote(domain.rlike("^[a-z]{2,6}$"), domain.rlike("^$|^[a-z]{7,}$"))).when(is_("phone"), vote(size.between(10, 13), size < 9)).when(is_("ip"), vote(found.rlike(":.*[0-9]|[0-9].*:") | ~found.rlike(r":|^0|\.0+[0-9]"), found.rlike(r"^0\.|^[^0-9]*$"))).when(is_("card"), vote(size.between(13, 19))).otherwise(vote(F.contains(found, F.lit("."))))
    edges = vote(((x["before"] == "") | x["before"].rlike(r"[\s(<\[\"':;,|]$")) & ((x["after"] == "") | x["after"].rlike(r"^[\s)>\]\"':;,.!?|]")), x["before"].rlike(r"[\p{L}0-9]$") & x["after"].rlike(r"^[\p{L}0-9]"))
    return F.array(*[v.cast("int") for v in (F.when(x["form"] == "base", 1).otherwise(0), shape, _listed(x), _near(x), edges)])


def traits(x: Column) -> Column:
    """Feature values of a span for the final classifier."""
    size = F.char_length(x["found"])
    share = F.char_length(_digits(x["found"])) / F.greatest(size, F.lit(1))
    edge = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("mark")
    values = {"size": F.least(F.floor(F.log2(size + 1)), F.lit(6)).cast("string"), "digits": F.floor(share * 4).cast("string"), "left": edge(F.right(x["before"], F.lit(1))), "right": edge(x["after"]), "form": x["form"], "blank": F.contains(x["found"], F.lit(" ")).cast("string"), "listed": _listed(x).cast("string"), "near": _near(x).cast("string")}
    return F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in values.items()])


def _odds(state: str = "", row: str = "") -> str:
    """SQL: log odds of a vote pattern."""
    return f"aggregate(sequence(0, {LABELERS - 1}), ln({state}prior / (1 - {state}prior)), (t, j) -> t + if({row}votes[j] = 0, 0D, ln({state}yes[3 * j + {row}votes[j] + 1] / {state}no[3 * j + {row}votes[j] + 1])))"


def reliabilities(patterns: DataFrame, rounds: int = 25, anchor: float = 0.0, balance: float | None = None) -> DataFrame:
    """kind, prior, yes, no: EM over the counts of vote patterns, as one fold a kind. patterns: kind, votes, n.

    anchor: weight of each labeler's starting reliability, as a share of the kind's spans; balance: a fixed prior.

    yes, no: chance of vote v of labeler j in place 3 * j + v + 1, among its votes that aren't 0, if the span is personal
    data and if it isn't. A 0 is an abstention and speaks neither for nor against.
    """
    by_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("seen"))
    places = 3 * LABELERS
    # EM starts from labelers that are better than chance, and from words before a span that seldom mislead
    yes = ", ".join({NEAR: "0.05D, 0.5D, 0.95D"}.get(j, "0.15D, 0.5D, 0.85D") for j in range(LABELERS))
    no = ", ".join({NEAR: "0.9D, 0.5D, 0.1D", EDGES: "0.35D, 0.5D, 0.65D"}.get(j, "0.6D, 0.5D, 0.4D") for j in range(LABELERS))
    odds = _odds("s.", "x.")
    posterior = f"transform(seen, x -> 1 / (1 + exp(-{odds})))"
    pick = lambda weight: f"aggregate(zip_with(seen, p, (x, y) -> if(x.votes[int(floor(k / 3))] + 1 = k % 3, x.n * {weight}, 0D)), 0D, (a, b) -> a + b)"
    total = lambda weight: f"aggregate(zip_with(seen, p, (x, y) -> x.n * {weight}), 0D, (a, b) -> a + b)"
    voted = lambda weight: f"aggregate(zip_with(seen, p, (x, y) -> if(x.votes[int(floor(k / 3))] = 0, 0D, x.n * {weight})), 0D, (a, b) -> a + b)"
    every = "aggregate(seen, 0D, (a, x) -> a + x.n)"
    held = f"(1D + {anchor}D * {every})"  # votes that hold a labeler to where it starts
    prior = f"({total('y')} + 1) / ({every} + 2)" if balance is None else f"{balance}D"
    step = f"""transform(array({posterior}), p -> named_struct(
        'prior', {prior},
        'yes', transform(sequence(0, {places - 1}), k -> ({pick('y')} + {held} * element_at(array({yes}), k + 1)) / ({voted('y')} + {held})),
        'no', transform(sequence(0, {places - 1}), k -> ({pick('(1 - y)')} + {held} * element_at(array({no}), k + 1)) / ({voted('(1 - y)')} + {held}))))[0]"""
    start = f"named_struct('prior', {0.7 if balance is None else balance}D, 'yes', array({yes}), 'no', array({no}))"
    return by_kind.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("s")).select("kind", "s.*")


def _map(rows: list[tuple]) -> Column:
    """A literal map; rows are few by construction."""
    return F.create_map(*[F.lit(x) for pair in rows for x in pair]) if rows else F.create_map(F.lit(""), F.lit(0.0))


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the final classifier: kind to its prior log odds, kind|feature=value to its log ratio. found: from candidates()."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.kind", votes(F.col("x")).alias("votes"), traits(F.col("x")).alias("traits"))
    spans = spans.groupBy("kind", "votes", "traits").agg(F.count("*").alias("n"))
    spans = tables.written(spans, "pii-patterns")
    model = reliabilities(spans.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")), anchor=ANCHOR, balance=BALANCE)
    odds = F.expr(_odds())
    labelled = spans.join(F.broadcast(model), "kind").select("kind", "traits", "n", (1 / (1 + F.exp(-odds))).alias("p"))  # a row a kind
    total = labelled.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("y"), F.sum(F.col("n") * (1 - F.col("p"))).alias("z"))
    value = labelled.select("kind", F.explode("traits").alias("trait"), "n", "p").groupBy("kind", "trait").agg(F.sum(F.col("n") * F.col("p")).alias("a"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b"))
    rows = value.join(F.broadcast(total), "kind").select(F.concat_ws("|", "kind", "trait").alias("k"), F.log(((F.col("a") + 1) / (F.col("y") + 5)) / ((F.col("b") + 1) / (F.col("z") + 5))).alias("w"))
    rows = rows.unionByName(total.select(F.col("kind").alias("k"), F.log((F.col("y") + 1) / (F.col("z") + 1)).alias("w")))
    return {r.k: r.w for r in rows.collect()}  # kinds x features x values at most


def annotate(found: DataFrame, weights: dict[str, float], into: str | None = None) -> DataFrame:
    """``spans`` in place of ``loose``: base spans and the looser ones that the classifier takes, by start, then kind."""
    known = _map(sorted(weights.items()))
    base, loose = (F.col(into)["base"], F.col(into)["loose"]) if into else (F.col("base"), F.col("loose"))
    score = lambda x: F.aggregate(traits(x), F.coalesce(F.try_element_at(known, x["kind"]), F.lit(0.0)), lambda t, v: t + F.coalesce(F.try_element_at(known, F.concat_ws("|", x["kind"], v)), F.lit(0.0)))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.element_at(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    taken = F.when(F.size(loose) > 0, F.filter(loose, lambda x: score(x) >= 0)).otherwise(loose)
    out = [ordered(base).alias("base"), ordered(F.concat(base, taken)).alias("spans")]
    rest = [F.col(f"`{c}`") for c in found.columns if c.lower() not in ({into.lower()} if into else {"base", "loose", "spans"})]
    return found.select(*rest, *([F.struct(*out).alias(into)] if into else out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap count as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        begin = F.greatest(s["at"], x["start"])
        part = F.concat(F.substring(text, s["at"] + 1, begin - s["at"]), F.when(x["start"] >= s["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.array_append(s["parts"], part).alias("parts"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))).otherwise(text)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
