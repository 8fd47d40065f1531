"""Secret scans: fixed patterns, and a sliding-window entropy over candidate strings, in SQL expressions only.

Each row is scanned alone, so nothing shuffles and no key can be hot. Positions come from the lengths of a pattern's
matches and of the text between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group whose length counts, least length. In this order kinds are sorted.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABETS = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="}
#: What is no secret inside a candidate: placeholders, counted-up alphabets, repeated signs. No window overlaps a match.
ALLOWED = r"(?i:example|sample|placeholder|changeme|dummy|redacted|abcdefgh|01234567|qwertyui)|(.)\1{7,}"
#: Whole candidates that are no secrets: slugs and paths of words, with a number of four digits at most.
BENIGN = r"^[a-z][a-z/_-]*[0-9]{0,4}$"
_SPANS = "array<struct<start:int,end:int>>"
_EMPTY = f"cast(array() as {_SPANS})"
_BLOCK = 256  # elements of a block of a running fold
_UNIT = 1 << 20  # units of n*log2(n): sums of whole numbers don't depend on their order


@dataclass(frozen=True)
class Entropy:
    """Windows of ``window`` signs (at most 31) with a digit and a letter whose Shannon entropy in bits reaches the class's threshold."""

    window: int = 24
    least: dict[str, float] = field(default_factory=lambda: {"hex": 3.2, "base64": 3.95})
    allowed: str = ALLOWED
    benign: str = BENIGN


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with value bound to a name, so that a lambda in body doesn't evaluate it for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, both: str) -> str:
    """SQL: running fold of an array of int by ``both`` of {a} and {b}, from 0.

    In blocks, because SQL can only append to an array by copying it.
    """
    add = lambda a, b: f"concat({a}, array({both.format(a=f'element_at({a}, -1)', b=b)}))"
    blocks = f"transform(sequence(0, greatest(size(v_) - 1, 0), {_BLOCK}), s_ -> slice(v_, s_ + 1, {_BLOCK}))"
    before = f"aggregate(k_, array(0), (a_, b_) -> {add('a_', f"aggregate(b_, 0, (y_, x_) -> {both.format(a='y_', b='x_')})")})"
    inside = f"(b_, f_) -> slice(aggregate(b_, array(f_), (a_, x_) -> {add('a_', 'x_')}), 2, size(b_))"
    return _let("v_", values, _let("k_", blocks, f"flatten(zip_with(k_, slice({before}, 1, size(k_)), {inside}))"))


def _placed(found: str, between: str) -> str:
    """SQL: (start, end) of each match, from the matches and the parts between them; code points, end exclusive."""
    length = f"zip_with({found}, slice({between}, 1, size({found})), (f_, g_) -> length(f_) + length(g_))"
    return f"zip_with({_running(length, '{a} + {b}')}, {found}, (e_, f_) -> named_struct('start', e_ - length(f_), 'end', e_))"


def _matches(text: str, pattern: str) -> str:
    """SQL: (start, end) of the pattern's matches in a text; null if there are none."""
    found = f"regexp_extract_all({text}, {_lit(pattern)}, 0)"
    return _let("m_", found, f"if(size(m_) = 0, cast(null as {_SPANS}), {_let('p_', f'split({text}, {_lit(pattern)}, -1)', _placed('m_', 'p_'))})")


def _windows(text: str, signs: str, fold_case: bool, e: Entropy, least: float) -> str:
    """SQL: starts of the windows of a string of ASCII signs that reach the entropy and hold a digit and a letter.

    While the window slides, one sign comes and one goes; their counts are kept, five bits a sign and twelve signs a
    long, and so is the sum of n*log2(n). A fold serves 64 windows, a bit each, so the work is linear in the string.
    """
    w = e.window
    slots = [-1] * 128
    for i, c in enumerate(signs):
        slots[ord(c)] = i
        if fold_case:
            slots[ord(c.upper())] = i
    sign = "array(" + ",".join(f"named_struct('id',{i},'w',{i // 12},'sh',{5 * (i % 12)},'one',{1 << 5 * (i % 12)}L,'d',{int(chr(c).isdigit())},'l',{int(chr(c).isalpha())})" if i >= 0 else "null" for c, i in enumerate(slots)) + ")"
    xlog = "array(" + ",".join(f"{round(n * math.log2(n) * _UNIT) if n else 0}L" for n in range(w + 2)) + ")"
    bound = math.floor((math.log2(w) - least) * w * _UNIT)
    came, went = "part_[i_]", f"get(part_, i_ - {w})"
    held = lambda x: f"cast(shiftright(a_.n[{x}.w], {x}.sh) & 31L as int)"
    high = f"a_.s <= {bound}L and a_.d > 0 and a_.l > 0"
    step = f"""named_struct(
        'n', transform(a_.n, (x_, k_) -> x_ + if(k_ = {came}.w, {came}.one, 0L) - if(k_ = {went}.w, {went}.one, 0L)),
        's', a_.s + if({came}.id = {went}.id, 0L, {xlog}[{held(came)} + 1] - {xlog}[{held(came)}]
            + if({went} is null, 0L, {xlog}[{held(went)} - 1] - {xlog}[{held(went)}])),
        'd', a_.d + {came}.d - coalesce({went}.d, 0),
        'l', a_.l + {came}.l - coalesce({went}.l, 0),
        'bits', if(i_ >= {w} and {high}, a_.bits | shiftleft(1L, i_ - {w}), a_.bits))"""
    start = f"named_struct('n', array_repeat(0L, {-(-len(signs) // 12)}), 's', 0L, 'd', 0, 'l', 0, 'bits', 0L)"
    bits = f"aggregate(sequence(0, size(part_) - 1), {start}, (a_, i_) -> {step}, a_ -> if({high}, a_.bits | shiftleft(1L, size(part_) - {w}), a_.bits))"
    marked = "if(bits_ = 0L, cast(array() as array<int>), filter(transform(sequence(0, 63), b_ -> if((shiftright(bits_, b_) & 1L) = 1L, from_ + b_, -1)), y_ -> y_ >= 0))"
    each = _let("part_", f"slice(codes_, from_ + 1, {63 + w})", _let("bits_", bits, marked))
    return _let("codes_", f"transform(split({text}, ''), c_ -> {sign}[ascii(c_)])", f"flatten(transform(sequence(0, size(codes_) - {w}, 64), from_ -> {each}))")


def _labelled(spans: str, order: int, kind: str) -> str:
    return f"transform({spans}, x -> named_struct('start', x.start, 'kind_order', {order}, 'end', x.end, 'kind', '{kind}'))"


def _high(text: str, e: Entropy) -> str:
    """SQL: merged (start, end) of the windows of high entropy in a text.

    A unit is a string to slide over and its place: the parts of a candidate between its allowed matches, and the runs
    of hexadecimal digits in them.
    """
    cand, hexa = f"[A-Za-z0-9+/_=-]{{{e.window},}}", f"[0-9A-Fa-f]{{{e.window},}}"
    both = lambda x: f"length({x}) >= {e.window} and {x} rlike '[0-9]' and {x} rlike '[A-Za-z]'"
    unit = lambda s, at: f"named_struct('s', {s}, 'at', {at})"
    # Parts of candidate c_ between its allowed matches m2_, which stand at w2_.
    parts = _let("r_", f"split(c_, {_lit(e.allowed)}, -1)", _let("w2_", _placed("m2_", "r_"), f"transform(r_, (q_, j_) -> {unit('q_', 'coalesce(get(w2_, j_ - 1).end, 0)')})"))
    parts = _let("m2_", f"regexp_extract_all(c_, {_lit(e.allowed)}, 0)", f"if(size(m2_) = 0, array({unit('c_', '0')}), {parts})")
    parts = f"transform(filter({parts}, u_ -> {both('u_.s')}), u_ -> {unit('u_.s', 'u_.at + o_.start')})"
    units = f"flatten(zip_with(c0_, o0_, (c_, o_) -> if({both('c_')} and not (c_ rlike {_lit(e.benign)}), {parts}, cast(array() as array<struct<s:string,at:int>>))))"
    units = _let("c0_", f"regexp_extract_all({text}, {_lit(cand)}, 0)", f"if(size(c0_) = 0, cast(null as array<struct<s:string,at:int>>), {_let('o0_', _let('r0_', f'split({text}, {_lit(cand)}, -1)', _placed('c0_', 'r0_')), units)})")
    digits = f"zip_with(h_, {_placed('h_', 'n_')}, (z_, o_) -> {unit('z_', 'o_.start + u_.at')})"
    runs = _let("h_", f"regexp_extract_all(u_.s, {_lit(hexa)}, 0)", f"if(size(h_) = 0, cast(array() as array<struct<s:string,at:int>>), {_let('n_', f'split(u_.s, {_lit(hexa)}, -1)', digits)})")
    runs = f"filter(flatten(transform(units_, u_ -> {runs})), u_ -> {both('u_.s')})"
    found = [f"flatten(transform({us}, u_ -> transform({_windows('u_.s', ALPHABETS[k], k == 'hex', e, e.least[k])}, x_ -> x_ + u_.at)))" for us, k in (("units_", "base64"), (runs, "hex"))]
    opens = f"filter(q_, (x_, i_) -> coalesce(x_ > get(q_, i_ - 1) + {e.window}, true))"
    closes = f"filter(q_, (x_, i_) -> coalesce(get(q_, i_ + 1) > x_ + {e.window}, true))"
    spans = _let("q_", f"array_sort(array_distinct(concat({', '.join(found)})))", f"zip_with({opens}, {closes}, (a_, b_) -> named_struct('start', a_, 'end', b_ + {e.window}))")
    return _let("units_", units, f"if(units_ is null or size(units_) = 0, {_EMPTY}, {spans})")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, entropy: Entropy | None = Entropy()) -> DataFrame:
    """(doc_id, spans array<struct<start, kind_order, end, kind>>) for each row of docs, spans by start, then kind.

    Kinds are those of BASE, leftmost and without overlap per kind, and ``entropy``: merged windows of high entropy that
    no span of BASE covers. A window lies in a candidate, a run of base64 signs; it holds a digit and a letter and
    overlaps no match of ``allowed``; windows of hexadecimal digits only reach the lower threshold of their class.
    Candidates that match ``benign`` have none. Null and empty texts have no spans. Null and repeated ids pass through;
    other columns are ignored. An empty table gives an empty result. The work grows as the text, for a text of one
    candidate or of many matches too.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        at = _matches("text", pattern)
        if group:  # its length counts, not the match's
            long_ = f"zip_with(at_, regexp_extract_all(text, {_lit(pattern)}, {group}), (x_, g_) -> if(length(g_) >= {least}, x_, null))"
            at = _let("at_", at, f"if(at_ is null, at_, filter({long_}, x_ -> x_ is not null))")
        parts.append(_labelled(f"coalesce({at}, {_EMPTY})", order, kind))
    rows = rows.select("doc_id", "text", F.array_sort(F.expr(f"concat({', '.join(parts)})")).alias("base"))
    if not entropy:
        return rows.select("doc_id", F.col("base").alias("spans"))
    kept = f"filter(all_, (x_, i_) -> x_.kind_order < {len(BASE)} or top_[i_] < x_.end)"
    ends = f"transform(all_, x_ -> if(x_.kind_order < {len(BASE)}, x_.end, -1))"
    merged = _let("all_", f"array_sort(concat(base, {_labelled('high_', len(BASE), 'entropy')}))", _let("top_", _running(ends, "greatest({a}, {b})"), kept))
    return rows.select("doc_id", F.expr(_let("high_", _high("text", entropy), f"if(size(high_) = 0, base, {merged})")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mask."""
    fold = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("out"),
        ),
    )
    return F.concat(fold["out"], F.substring(text, fold["at"] + 1, F.length(text)))
