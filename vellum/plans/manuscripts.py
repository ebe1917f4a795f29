"""The derived tables of before/after pairs over which the pair and section audits run, in Spark and in DuckDB.

A document's whole text becomes the prose of nine sections, its digits written
as letters so that numbers stand only where the view puts them; inserted
sentences vary with the document's id, so that every rule has rows on which it
fires and rows on which it doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 9
_S = (
    "The evidence suggests an effect in this cohort. It cannot be extended to other groups. Future work should test it.",
    "Results were found to be stable, clear, and complete. However, the limitation remains. We may need to repeat it.",
    "The central judgement is bounded. It does not identify a cause. The priority is replication.",
    "It is important to note that the method plays a crucial role. Therefore the design must not change because of cost.",
    "This report observed a link. It is not equivalent to proof rather than support. Studies should follow.",
)


def _pieces(column: str, after: bool) -> list[tuple[str, str]]:
    """(kind, value) of what is joined: literals, the id, prose of a part, and literals that depend on the id (modulus, if 0, else)."""
    out: list[tuple[str, str]] = [("lit", "# Report "), ("id", ""), ("lit", "\n\n## Abstract\n\nThis study reports a dose of ")]
    out += [("mod", "3|25 mg|50 mg" if after else "1|50 mg|50 mg"), ("lit", "  in  "), ("num", "7"), ("lit", "  groups [1, 2].  It should not be read as final; p < 0.05 was found."), ("mod", "6|本研究结果表明效果，但不能证明因果。|" if after else "6|本研究结果表明效果。|"), ("lit", "\n\n")]
    for k in range(1, PARTS + 1):
        body = [("lit", f"## {k}. Part {k}\n\n"), ("part", str(k - 1)), ("lit", f"\n\n{_S[k % len(_S)]}")]
        if after and k in (2, 3):
            body.append(("mod", f"{4 * (k - 1)}| The supplied text leaves interface residue here.|"))
        if after and k in (4, 5, 6, 7, 8):
            body.append(("mod", "5| [SOURCE REQUIRED: one]|"))
        body.append(("lit", "\n\n"))
        if after and k == 5:
            out.append(("drop", "7"))
            out += body
            out.append(("end", ""))
        else:
            out += body
    if after:
        out.append(("mod", "11|## Outlook\n\nA new part without doubt.\n\n|"))
    out += [("lit", "## Conclusion\n\n"), ("mod", "2|This study reports a dose and it may cause harm.|This study reports a dose in groups and it can cause harm without doubt." if after else "1|This study reports a dose in groups and it could cause harm without doubt.|"), ("lit", "\n\n## References\n\n[1] Doe (2019). https://doi.org/10.1234/abc."), ("mod", "9|x|y" if after else "1|y|y"), ("lit", ".\n")]
    return out


def _prose(lines: Column) -> Column:
    """For each part its lines, joined: every PARTS-th from its own place on."""
    part = lambda k: F.array_join(F.transform(F.sequence(F.lit(k), F.size(lines) - 1, F.lit(PARTS)), lambda n: F.get(lines, n)), "\n\n")
    return F.array(*(F.when(F.size(lines) > k, part(k)).otherwise("") for k in range(PARTS)))


def _spark(after: bool) -> Column:
    """One version, from the columns doc_id and prose."""
    i, stack, out = F.col("doc_id"), [], []

    for kind, value in _pieces("text", after):
        if kind == "drop":
            stack.append((value, out))
            out = []
            continue
        if kind == "end":
            modulus, outer = stack.pop()
            out = [*outer, F.when(i % int(modulus) == 0, "").otherwise(F.concat(*out))]
            continue
        if kind == "mod":
            m, yes, no = value.split("|")
            out.append(F.when(i % int(m) == 0, yes).otherwise(no))
        elif kind == "num":
            out.append((i % int(value) + 2).cast("string"))
        else:
            out.append(F.lit(value) if kind == "lit" else i.cast("string") if kind == "id" else F.get("prose", F.lit(int(value))))
    return F.concat(*out)


def _sql(after: bool) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lines = "string_split(translate(coalesce(text, ''), '0123456789#', 'abcdefghijh'), chr(10))"
    stack: list[tuple[str, list[str]]] = []
    out: list[str] = []
    for kind, value in _pieces("text", after):
        if kind == "drop":
            stack.append((value, out))
            out = []
        elif kind == "end":
            modulus, outer = stack.pop()
            out = [*outer, f"case when doc_id % {modulus} = 0 then '' else {' || '.join(out)} end"]
        elif kind == "mod":
            m, yes, no = value.split("|")
            out.append(f"case when doc_id % {m} = 0 then {q(yes)} else {q(no)} end")
        elif kind == "num":
            out.append(f"(doc_id % {value} + 2)::varchar")
        elif kind == "part":
            out.append(f"array_to_string(list_filter({lines}, lambda x, n: (n - 1) % {PARTS} = {value}), chr(10) || chr(10))")
        else:
            out.append(q(value) if kind == "lit" else "doc_id::varchar")
    return " || ".join(out)


def manuscripts(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, before, after."""
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), "0123456789#", "abcdefghijh"), "\n", -1)
    rows = docs.where("doc_id is not null").select("doc_id", lines.alias("lines")).select("doc_id", _prose(F.col("lines")).alias("prose"))
    return rows.select("doc_id", _spark(False).alias("before"), _spark(True).alias("after"))


MANUSCRIPTS_SQL = f"m as (select doc_id, {_sql(False)} as before, {_sql(True)} as after from documents where doc_id is not null)"


def chinese(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, text: a Chinese sentence for each line, chosen by the line's length."""
    known = F.array(*(F.lit(s) for s in ("本研究结果表明方法有效。", "数据分析方法仍需验证。", "深度学习模型有效。", "证据不能证明因果关系。", "未来研究应当检验方法。")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", F.array_join(F.transform(lines, lambda x: F.get(known, F.length(x) % 5)), "").alias("text"))
