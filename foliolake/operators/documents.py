"""Whole-document operators on (doc_id, content) tables: every change and export is an Arrow function over the bytes.

A document that fails has a status and no content; the job goes on. Options may be columns, so that they vary by document. A document that a user
password (or none) opens allows only what its ``/P`` allows; what is saved of an encrypted document is no longer encrypted."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pdf import conform, crypto, detect, edit, export, raster
from ..sources.pdf.cos import Document, PdfError, Ref

_STATUS = "struct<code:string,message:string>"
#: What a user must be allowed to do for each change; changes that aren't named need ``modify``.
NEEDS = (
    {n: "assemble" for n in ("delete_pages", "reorder_pages", "insert_blank", "duplicate_page", "rotate", "set_rotation", "set_box", "set_outlines", "add_outline", "clear_outlines", "extract_pages")}
    | {n: "annotate" for n in ("markup", "link", "stamp", "shape", "delete_annotation")}
    | {n: "create_field" for n in ("create_field", "update_field", "delete_field", "flatten_forms", "hard_flatten", "flatten_annotations")}
    | {"fill": "fill", "fill_sign": "fill"}
)


def _opened(data: bytes | None, password: str = "", action: str | None = None) -> Document:
    doc = Document.load(bytes(data or b""))
    if crypto.revision(doc) is not None:
        crypto.open_with(doc, password)
        if action and not doc.owner and not crypto.permitted(doc.perms, action):
            raise PdfError("PERMISSION_DENIED", f"the document does not allow this ({action})")
        doc.load_all()
        doc.trailer.pop("Encrypt", None)
    return doc


def _tried(run: Callable, *args):
    """(result, status)"""
    try:
        return run(*args), {"code": "OK", "message": None}
    except PdfError as e:
        return None, {"code": e.code, "message": str(e)}
    except (ValueError, TypeError, KeyError, IndexError, RecursionError, OverflowError, AttributeError) as e:
        return None, {"code": "MALFORMED", "message": f"{type(e).__name__}: {e}"}


def _plain(x):
    """A report as JSON can hold it."""
    if isinstance(x, Ref):
        return x.num
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _mapped(files: DataFrame, run: Callable, kind: str = "binary", out: str = "content", columns: dict[str, Column] | None = None) -> DataFrame:
    """``files`` with what ``run(data, values)`` gives, (result, report), in columns ``out``, report and status."""
    columns = columns or {}
    names = list(columns)

    @F.pandas_udf(f"struct<out:{kind},report:string,status:{_STATUS}>")
    def each(content, *values):
        import pandas as pd

        rows = []
        for i, data in enumerate(content):
            # Arrow hands arrays and structs over as numpy arrays and dicts.
            given = {n: v.iloc[i].tolist() if hasattr(v.iloc[i], "tolist") else v.iloc[i] for n, v in zip(names, values)}
            found, status = _tried(run, data, given)
            result, report = found or (None, None)
            rows.append((result, None if report is None else json.dumps(_plain(report), sort_keys=True), status))
        return pd.DataFrame(rows, columns=["out", "report", "status"])

    kept = [c for c in files.columns if c not in ("content", "status", "report")]
    own = files.select(*kept, each("content", *columns.values()).alias("__r"))
    return own.select(*kept, F.col("__r.out").alias(out), F.col("__r.report").alias("report"), F.col("__r.status").alias("status"))


def _split_options(options: dict) -> tuple[dict, dict[str, Column]]:
    fixed = {k: v for k, v in options.items() if not isinstance(v, Column)}
    return fixed, {k: v for k, v in options.items() if isinstance(v, Column)}


def change(files: DataFrame, name: str, *args, password: str = "", **options) -> DataFrame:
    """``files`` with one of ``sources.pdf.edit``'s changes made to every document: its bytes, a report (JSON) of what the change returned, a status."""
    return change_all(files, [(name, args, options)], password)


def change_all(files: DataFrame, steps: list[tuple[str, tuple, dict]], password: str = "") -> DataFrame:
    """Several changes in one pass; the report is a list where there are several."""
    columns: dict[str, Column] = {}
    plan = []
    for k, (name, args, options) in enumerate(steps):
        named, own = _split_options(options)
        places = {i: a for i, a in enumerate(args) if isinstance(a, Column)}
        columns |= {f"{k}.{n}": c for n, c in own.items()} | {f"{k}.{i}": c for i, c in places.items()}
        plan.append((name, [None if i in places else a for i, a in enumerate(args)], named, list(places), list(own)))

    def run(data, values):
        doc, reports, out = _opened(data, password, NEEDS.get(plan[0][0], "modify")), [], None
        for k, (name, args, named, places, own) in enumerate(plan):
            args = list(args)
            for i in places:
                args[i] = values[f"{k}.{i}"]
            out = getattr(edit, name)(doc, *args, **named, **{n: values[f"{k}.{n}"] for n in own})
            if isinstance(out, Document):
                doc, out = out, None
            if isinstance(out, bytes):
                doc, out = Document.load(out), {"size": len(out)}
            reports.append(out)
        signed = name == "attest"
        return doc.data if signed else doc.save(), reports[0] if len(reports) == 1 else reports

    return _mapped(files, run, columns=columns)


def encrypt(files: DataFrame, owner: str, user: str = "", perms: int | Column = -4, revision: int = 6) -> DataFrame:
    fixed, columns = _split_options({"perms": perms})
    return _mapped(files, lambda data, v: (crypto.encrypt(_opened(data), owner, user, int((fixed | v)["perms"]), revision).save(), None), columns=columns)


def decrypt(files: DataFrame, password: str) -> DataFrame:
    def run(data, _):
        doc = _opened(data, password)
        edit.strip_active(doc)
        return doc.save(), None

    return _mapped(files, run)


def pack(files: DataFrame, password: str = "") -> DataFrame:
    """Objects in compressed object streams, the cross-references in a stream."""
    return _mapped(files, lambda data, _: (_opened(data, password, "modify").save_packed(), None))


def merge(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, content, inputs, status): the documents of a group, in order, as one. A group meets in one task, since it becomes one file.

    ``inputs`` has a status for each document of the group, in order; those that can't be read are left out, and a group of such alone has no content."""
    # Dealt over more partitions than cores, by a number, which keeps Spark from joining them: a few groups would lie unevenly over a few tasks.
    dealt = files.repartition(8 * files.sparkSession.sparkContext.defaultParallelism, *keys)
    own = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "content"))).alias("__all"))

    @F.pandas_udf(f"struct<content:binary,inputs:array<{_STATUS}>,status:{_STATUS}>")
    def run(groups):
        import pandas as pd

        def opened(group, told):
            """Documents one after the other, so that only what is copied of them stays."""
            for x in group:
                doc, status = _tried(_opened, x, "", "copy")
                told.append(status)
                if doc is not None:
                    yield doc

        rows = []
        for g in groups:
            told: list = []
            docs = opened(g, told)
            content, status = _tried(lambda d: edit.merge(d).save(), docs)
            for _ in docs:  # where merging fails, the inputs behind it have a status too
                pass
            if all(s["code"] != "OK" for s in told):
                content, status = None, told[0]
            rows.append((content, told, status))
        return pd.DataFrame(rows, columns=["content", "inputs", "status"])

    return own.select(*keys, run(F.col("__all.content")).alias("__r")).select(*keys, "__r.content", "__r.inputs", "__r.status")


def _exploded(files: DataFrame, run: Callable, number: str, out: str) -> DataFrame:
    """A row for each of the results of ``run(data)``; one with nulls and the status where it fails."""
    found = _mapped(files, lambda data, _: (run(data), None), "array<binary>", "__out").drop("report")
    kept = [c for c in found.columns if c != "__out"]
    return found.select(*kept, F.posexplode_outer("__out").alias(number, out))


def split(files: DataFrame, size: int, password: str = "") -> DataFrame:
    """(columns, status, part, content): parts of ``size`` pages."""
    return _exploded(files, lambda data: [d.save() for d in edit.split(_opened(data, password, "copy"), size)], "part", "content")


def render(files: DataFrame, kind: str = "png", dpi: float = 144, password: str = "") -> DataFrame:
    """(columns, status, page_index, picture) of every page."""

    def pages(data):
        doc = _opened(data, password, "print")
        return [raster.render(doc, i, kind, dpi) for i in range(len(doc.pages()))]

    return _exploded(files, pages, "page_index", "picture")


def export_as(files: DataFrame, kind: str, password: str = "") -> DataFrame:
    """``kind`` is markdown, docx, xlsx or pptx."""
    write = getattr(export, kind)

    def run(data, _):
        out = write(_opened(data, password, "copy"))
        return out.encode() if isinstance(out, str) else out, None

    return _mapped(files, run)


def to_archive(files: DataFrame, part: int = 1) -> DataFrame:
    """PDF/A copies; documents that can't be made to conform keep a status that says why."""
    return _mapped(files, lambda data, _: (conform.to_archive(_opened(data, "", "modify"), part).save(), None))


def tag(files: DataFrame, language: str = "en") -> DataFrame:
    """Documents with a structure tree (structural only)."""

    def run(data, _):
        doc = _opened(data, "", "modify")
        return (conform.tag(doc, language=language), doc)[1].save(), None

    return _mapped(files, run)


def append_saved(files: DataFrame, name: str, *args, **options) -> DataFrame:
    """A change whose result is put behind the bytes that were there, which keeps signatures over them valid."""

    def run(data, _):
        doc = Document.load(bytes(data or b""))
        report = getattr(edit, name)(doc, *args, **options)
        return conform.save_appended(doc), report

    return _mapped(files, run)


def add_detected_fields(files: DataFrame) -> DataFrame:
    def run(data, _):
        doc = _opened(data, "", "create_field")
        return (sum(detect.apply(doc, i) for i in range(len(doc.pages()))), doc)[1].save(), None

    return _mapped(files, run)


def recognised(files: DataFrame, index: int, tsv: Column, width_px: Column, height_px: Column) -> DataFrame:
    """An invisible text layer from a recogniser's table (tab-separated)."""

    def run(data, v):
        doc = _opened(data, "", "modify")
        words = edit.parse_ocr_tsv(v["tsv"])
        return (done := edit.ocr_layer(doc, index, words, int(v["w"]), int(v["h"])), doc)[1].save(), {"words": len(words), "drawn": done}

    return _mapped(files, run, columns={"tsv": tsv, "w": width_px, "h": height_px})
