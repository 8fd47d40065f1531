"""Fill-in-middle transformation: SQL of an embedded DuckDB over each Arrow batch, no per-row Python.

The form of a text and its two cuts follow from a hash of its id, so any task gives a row the same result. A text is
matched left to right in blocks of 64 code points, and only the two blocks that hold a cut are matched code point by
code point; so a long text costs a few bytes a code point. Rows are independent: nothing shuffles and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN_FROM, SPM_BELOW = 90, 20  # percent: h3 % 100 from here on stays plain, h4 % 100 below is suffix first
_BLOCK = 64
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _sql(seed: str, marks: tuple[str, str, str], plain_from: int, spm_below: int) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    p, s, m = map(lit, marks)
    joined = lambda x: f"array_to_string({x}, '')"
    marked = " OR ".join(f"contains(text, {x})" for x in (p, s, m))
    hashes = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH hashed AS (SELECT doc_id, text, length(text)::UBIGINT AS n, {hashes}
  FROM (SELECT doc_id, coalesce(text, '') AS text, sha256({lit(seed)} || coalesce(doc_id::VARCHAR, '')) AS h FROM batch)),
formed AS (SELECT doc_id, text, n::BIGINT AS n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS i, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS j,
    CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {plain_from} THEN 'plain' WHEN h4 % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM hashed),
blocks AS (SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{_BLOCK}}}') END AS b, i // {_BLOCK} AS bi, i % {_BLOCK} AS oi, j // {_BLOCK} AS bj, j % {_BLOCK} AS oj FROM formed),
units AS (SELECT *, regexp_extract_all(coalesce(b[bi + 1], ''), '(?s).') AS ui, regexp_extract_all(coalesce(b[bj + 1], ''), '(?s).') AS uj FROM blocks),
parts AS (SELECT doc_id, n, form, i, j, text,
    {joined('list_slice(b, 1, bi)')} || {joined('list_slice(ui, 1, oi)')} AS prefix,
    CASE WHEN bi = bj THEN {joined('list_slice(ui, oi + 1, oj)')} ELSE {joined('list_slice(ui, oi + 1, len(ui))')} || {joined('list_slice(b, bi + 2, bj)')} || {joined('list_slice(uj, 1, oj)')} END AS middle,
    {joined('list_slice(uj, oj + 1, len(uj))')} || {joined('list_slice(b, bj + 2, len(b))')} AS suffix FROM units)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parts"""


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that part an output in one way only: none is empty, lies in another, or begins as another ends."""
    for a in marks:
        for i, b in enumerate(marks):
            if not a or (a in b and marks.index(a) != i) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks that can run into each other: {a!r}, {b!r}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, marks: tuple[str, str, str] = MARKS, seed: str = "1:", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    n counts code points. The cuts of a text are h1 % (n + 1) and h2 % (n + 1) with h1 to h4 the leading 32-bit numbers
    of the SHA-256 of seed and id. form is plain (the text as it is; its counts are null) for empty texts, those that
    hold a mark, and where h3 % 100 >= plain_from; else spm where h4 % 100 < spm_below, else psm. Null texts count as
    empty. Null ids hash as nothing; repeated ids give the same form. Other columns are ignored. An empty table gives an
    empty result.
    """
    check_marks(marks)
    bounded_batches(docs.sparkSession)
    sql = _sql(seed, marks, plain_from, spm_below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().cast(_OUT).to_batches()
                con.unregister("batch")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A text that is cut holds no mark, and marks cannot run into each other, so the first of each is the mark."""
    p, s, m = marks

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        head = F.substring_index(body, second, 1)
        rest = F.substring_index(body, second, -1)
        return head, F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    psm, spm = between(p, s), between(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


ORACLE = r"""
with h as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as x from documents),
u as (select doc_id, text, regexp_extract_all(text, '(?s).') as u, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as j,
  case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:i], '') as pre, array_to_string(u[i + 1:j], '') as mid, array_to_string(u[j + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""
