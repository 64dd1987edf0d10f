"""Markdown: blocks, header paths, size bounds, sections, links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*(?:[\s/>]|$)|!--|\?|![A-Z])")


_SHIELDED = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)", re.S)
_PUNCTUATION = {c: 0xE000 + c for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]}
_BACK = {v: k for k, v in _PUNCTUATION.items()}


def inline(text: str) -> str:
    """Text of inline markup: images go, links keep their words only; code, em and strong keep one notation.
    Escaped marks, and marks in code, are none."""
    text = _SHIELDED.sub(lambda m: m[1].translate(_PUNCTUATION) if m[1] else f"{chr(0xE000 + 96)}{m[3].translate(_PUNCTUATION)}{chr(0xE000 + 96)}", text)
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)", r"\1", text)
    text = re.sub(r"<(https?://[^>\s]+)>", r"\1", text)
    text = re.sub(r"__(?=\S)(.+?)(?<=\S)__", r"**\1**", text)
    text = re.sub(r"(?<![\w_])_(?=\S)([^_]+?)(?<=\S)_(?![\w_])", r"*\1*", text)
    return text.translate(_BACK)


def heading_text(depth: int, title: str) -> str:
    if depth <= 4:
        return f"{'#' * depth} {title}"
    return f"**{title}**\n" if title else "** **"


def _tidy(text: str) -> str:
    return "\n".join(line for line in text.split("\n") if line.strip())


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


def segments(source: str, recover: bool = False) -> list[dict]:
    """Top-level blocks: text, type, header_path. A heading's own text, with its marks, ends its path. With
    `recover` a heading without words takes those of the paragraph after it."""
    lines = source.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n")
    out: list[dict] = []
    path: list[str] = []
    i, n = 0, len(lines)

    def emit(kind: str, text: str) -> None:
        out.append({"text": _tidy(text), "type": kind, "header_path": list(path)})

    def head(depth: int, title: str) -> None:
        nonlocal i
        title = inline(title.strip())
        if recover and not title:
            after = i + 1
            while after < n and not lines[after].strip():
                after += 1
            body = []
            while after < n and lines[after].strip() and not opens(lines[after]) and not lines[after].startswith("    "):
                body.append(lines[after].strip())
                after += 1
            if body:
                title, i = inline(" ".join(body)), after - 1
        text = heading_text(depth, title)
        path[:] = [*path[: depth - 1], text]
        emit("heading", text)

    def opens(line: str) -> bool:
        item = _ITEM.match(line)
        return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") or _HTML.match(line) or (item and item[3] and item[2] in ("-", "*", "+", "1.", "1)")))

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _ATX.match(line):
            head(len(m[1]), m[2] or "")
            i += 1
        elif m := _FENCE.match(line):
            body, i = [], i + 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            emit("code", "```\n" + "\n".join(body) + "\n```")
        elif _RULE.match(line):
            i += 1
        elif line.startswith("    "):
            body = []
            while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            emit("code", "```\n" + "\n".join(body).rstrip("\n") + "\n```")
        elif line.lstrip().startswith(">"):
            body = []
            while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or not opens(lines[i])):
                body.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            emit("quote", "\n".join("> " + inline(x) for x in body if x.strip()))
        elif m := _ITEM.match(line):
            ordered = m[2][0].isdigit()
            number, items = int(m[2][:-1]) if ordered else 0, []
            indent = len(m[1]) + len(m[2]) + 1
            while i < n:
                m = _ITEM.match(lines[i])
                if m and m[2][0].isdigit() == ordered and not _RULE.match(lines[i]):
                    items.append([m[3] or ""])
                elif not lines[i].strip():
                    if i + 1 >= n or not (lines[i + 1].startswith(" " * indent) or _ITEM.match(lines[i + 1])):
                        break
                elif lines[i].startswith(" " * min(indent, 2)) or not opens(lines[i]) and lines[i - 1].strip():
                    nested = re.match(r"\s*(?:[-*+]|\d{1,9}[.)])\s+(.*)", lines[i])
                    items[-1].append(nested[1] if nested else lines[i].strip())
                else:
                    break
                i += 1
            emit("list", "\n".join(f"{f'{number + k}.' if ordered else '-'} {inline(' '.join(x).strip())}" for k, x in enumerate(items)))
        elif _HTML.match(line):
            body = []
            while i < n and lines[i].strip():
                body.append(lines[i])
                i += 1
            emit("html", "\n".join(body))
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            rows = [_cells(line)]
            i += 2
            while i < n and lines[i].strip() and not opens(lines[i]):
                rows.append(_cells(lines[i]))
                i += 1
            text = [" | ".join(r) for r in rows]
            emit("table", "\n".join([text[0], " | ".join("---" for _ in rows[0]), *text[1:]]))
        else:
            body = []
            while i < n and lines[i].strip() and (not body or not opens(lines[i])):
                if body and (m := _SETEXT.match(lines[i])):
                    head(1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in body))
                    body = []
                    i += 1
                    break
                body.append(lines[i])
                i += 1
            if body:
                emit("paragraph", inline("\n".join(x.strip() for x in body)))
    return out


def merge_tiny(parts: list[dict], least: int) -> list[dict]:
    """A block shorter than `least` joins the one before, if neither is a heading and both have one path. Blank ones go."""
    out: list[dict] = []
    for p in parts:
        if not p["text"].strip():
            continue
        if len(p["text"]) < least and out and "heading" not in (p["type"], out[-1]["type"]) and out[-1]["header_path"] == p["header_path"]:
            out[-1] = {**out[-1], "text": out[-1]["text"] + "\n" + p["text"]}
        else:
            out.append(p)
    return out


def group_by_path(parts: list[dict]) -> list[dict]:
    """Runs of one header path, joined by blank lines. Text before the first heading starts with one."""
    out: list[dict] = []
    path, text = [], ""
    for p in parts:
        if p["header_path"] != path:
            if text.strip():
                out.append({"text": text, "header_path": path})
            path, text = p["header_path"], p["text"]
        else:
            text += "\n\n" + p["text"]
    if text.strip():
        out.append({"text": text, "header_path": path})
    return out


def group_by_heading(parts: list[dict], least: int, most: float) -> list[dict]:
    """A new chunk at every heading, which opens it; then the size bounds."""
    out: list[dict] = []
    for p in parts:
        if p["type"] == "heading" or not out:
            out.append({"text": p["text"], "header_path": p["header_path"]})
        else:
            out[-1] = {**out[-1], "text": out[-1]["text"] + "\n\n" + p["text"]}
    return bound_sizes(out, least, most)


def bound_sizes(chunks: list[dict], least: int, most: float) -> list[dict]:
    """Cuts chunks of `most` characters and over into slices; a short one goes into its neighbour: one that
    starts with a heading mark into the next, whatever its path, else into the one before or the next of its path."""
    out: list[dict] = []
    waiting = [dict(c) for c in chunks]
    for i, c in enumerate(waiting):
        text = c["text"].strip()
        after = waiting[i + 1] if i + 1 < len(waiting) else None
        if len(text) >= most:
            step = int(most)
            out += [{"text": text[k : k + step], "header_path": c["header_path"]} for k in range(0, len(text), step)]
        elif len(text) >= least:
            out.append({"text": text, "header_path": c["header_path"]})
        elif c["text"].startswith("#") and after is not None:
            after["text"] = c["text"] + "\n\n" + after["text"]
        elif out and out[-1]["header_path"] == c["header_path"]:
            out[-1]["text"] += "\n\n" + text
        elif after is not None and after["header_path"] == c["header_path"]:
            after["text"] = text + "\n\n" + after["text"]
        else:
            out.append({"text": text, "header_path": c["header_path"]})
    return out


def split_markdown(source: str, least: int = 30, most: float = 2000, headings_only: bool = False) -> list[dict]:
    parts = merge_tiny(segments(source), least)
    return group_by_heading(parts, least, most) if headings_only else group_by_path(parts)


def _over_batches(fn):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, x) for i, text in zip(batch["id"], batch["text"]) if text is not None for k, x in enumerate(fn(text))]
            columns = {"id": [r[0] for r in rows], "pos": [r[1] for r in rows], "text": [r[2]["text"] for r in rows], "type": [r[2].get("type") for r in rows], "header_path": [r[2]["header_path"] for r in rows]}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    return run


def _frame(df: DataFrame, fn, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_over_batches(fn), f"id {rows.schema['id'].dataType.simpleString()}, pos int, text string, type string, header_path array<string>").withColumnRenamed("id", id_col)


def markdown_segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, text, type, header_path of every block."""
    return _frame(df, segments, id_col, text_col)


def markdown_chunks(df: DataFrame, least: int = 30, most: float = 2000, headings_only: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, text, header_path of every chunk."""
    return _frame(df, lambda t: split_markdown(t, least, most, headings_only), id_col, text_col).drop("type")


def header_runs(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """group_by_path() over a table of blocks, by window functions: id, run, text, header_path."""
    w = Window.partitionBy(id_col).orderBy("pos")
    path = F.col("header_path")
    first = F.coalesce(F.lag("header_path").over(w), F.array().cast("array<string>"))
    marked = parts.withColumn("run", F.sum((path != first).cast("int")).over(w))
    grouped = marked.groupBy(id_col, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "header_path"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return grouped.select(id_col, "run", F.when(F.col("run") == 0, F.concat(F.lit("\n\n"), body)).otherwise(body).alias("text"), F.get("p", F.lit(0))["header_path"].alias("header_path"))


def sections(text: Column) -> Column:
    """Setext sections of a text as array<struct<slug,header,body>>: a header is a line of at most four words,
    or in capitals, over three dashes or equals signs and more; what precedes the first is Breaking News;
    other underlined lines stay in the body."""
    text = F.regexp_replace(text, r"(?s)^.*?Markdown Content:\n", "")
    marked = F.regexp_replace(text, r"(?m)^(?=(?:\S+(?: +\S+){0,3}|[^a-z\n]*[A-Z][^a-z\n]*) *\n(?:-{3,}|={3,}) *$)", "\u0001")
    parts = F.split(marked, "\u0001")
    first = F.struct(F.lit("breaking-news").alias("slug"), F.lit("Breaking News").alias("header"), F.trim(F.get(parts, F.lit(0))).alias("body"))

    def one(p: Column) -> Column:
        header = F.trim(F.regexp_extract(p, r"^([^\n]*)", 1))
        slug = F.regexp_replace(F.regexp_replace(F.lower(header), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
        return F.struct(slug.alias("slug"), header.alias("header"), F.trim(F.regexp_replace(p, r"^[^\n]*\n[-=]{3,} *\n?", "")).alias("body"))

    return F.filter(F.concat(F.array(first), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)), lambda s: (s["slug"] != "breaking-news") | (s["body"] != ""))


_URL_IN_LINK = r"\]\((http[^()\s]*(?:\([^()]*\)[^()\s]*)*)"


def unique_links(text: Column) -> Column:
    """Distinct targets of links that start with http, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_URL_IN_LINK), F.lit(1)))


def articles(df: DataFrame, ignored: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, url, title, image of linked articles: an image link gives picture and caption to the links
    after it, a link without words takes the caption, ignored titles go, and of one url the first title
    stays, with the last picture."""
    link = r"(?:\[!\[(?:Image \d+:? ?)?([^\]]*)\]\(([^)\s]+)[^)]*\)\]\((http[^)\s]+)[^)]*\)|(?<!!)\[([^\]\[]*)\]\((http[^)\s]+)[^)]*\))"
    both = [F.regexp_extract_all(F.col(text_col), F.lit(link), F.lit(g)) for g in range(1, 6)]
    rows = df.select(id_col, F.posexplode(F.arrays_zip(*[b.alias(n) for b, n in zip(both, ("caption", "image", "image_url", "title", "url"))])).alias("pos", "l")).select(id_col, "pos", *[F.when(F.col(f"l.{n}") != "", F.trim(F.col(f"l.{n}"))).alias(n) for n in ("caption", "image", "image_url", "title", "url")])
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(id_col, "pos", F.coalesce("url", "image_url").alias("url"), F.coalesce("title", "caption", F.last("caption", True).over(w)).alias("title"), F.last("image", True).over(w).alias("image"))
    keep = F.col("title").isNotNull()
    for phrase in ignored:
        keep = keep & ~F.contains("title", F.lit(phrase))
    return rows.where(keep).groupBy(id_col, "url").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), F.max_by("image", "pos").alias("image")).select(id_col, "pos", "url", "title", "image")
