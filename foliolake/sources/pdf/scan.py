"""PDF bytes to typed tables: what each table holds, and the DataFrame functions that make them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
#: The columns of every table after ``doc_id``.
TABLES = {
    "documents": "n_pages int, size long, encrypted boolean, algorithm string, perms int",
    "pages": f"page_index int, page_number int, obj_num int, rotation int, media {_BOX}, crop {_BOX}, bleed {_BOX}, trim {_BOX}, art {_BOX}",
    "xref": "num int, gen int, kind string, offset long, container int, idx int, revision int",
    "cos_objects": "num int, kind string, value string, stream binary, refs array<int>",
    "ops": "page_index int, op_seq int, depth int, operator string, operands string",
    "fonts": "page_index int, resource string, base_font string, family string, weight int, style string, is_composite boolean, default_width double, widths map<int,double>, to_unicode map<int,string>",
    "fonts_embedded": "page_index int, resource string, data binary",
    "glyphs": f"page_index int, seq int, char_code int, unicode string, x double, y double, advance double, bbox {_BOX}, font string, font_size double, rendered_size double, node int",
    "spans": f"page_index int, span_id int, line_id int, paragraph_id int, text string, bbox {_BOX}, font string, font_size double, rendered_size double, baseline_y double",
    "lines": f"page_index int, line_id int, paragraph_id int, text string, bbox {_BOX}, baseline_y double, start_x double, end_x double, char_start int, char_end int",
    "paragraphs": f"page_index int, paragraph_id int, text string, bbox {_BOX}, alignment string, leading double, line_count int, font string, rendered_size double",
    "segments": "page_index int, seq int, axis string, pos double, lo double, hi double",
    "table_cells": f"page_index int, table_idx int, row_idx int, col_idx int, row_span int, col_span int, bbox {_BOX}, text string, is_header boolean",
    "images": f"page_index int, seq int, obj_num int, resource string, width_px int, height_px int, color_space string, bits int, filter string, byte_size long, bbox {_BOX}, ctm array<double>",
    "scans": "page_index int, obj_num int",
    "form_fields": f"obj_num int, name string, alt_name string, field_type string, value string, default_value string, rect {_BOX}, page_number int, options array<string>, flags int, is_read_only boolean, is_required boolean, is_multiline boolean, max_length int",
    "form_candidates": f"page_index int, page_number int, candidate_id int, field_type string, suggested_name string, label string, rect {_BOX}, confidence double",
    "annotations": f"page_index int, obj_num int, subtype string, rect {_BOX}, color array<double>, opacity double, contents string, link_uri string, link_page int, stamp string, date string, border_width double, fill array<double>, points array<array<double>>, line_ending string",
    "outlines": "path array<int>, title string, page_number int, top double, left double, zoom double, uri string, is_open boolean, bold boolean, italic boolean, color array<double>",
    "attachments": "name string, filename string, mime string, size long, description string, created string, modified string, md5 string, sha256 string, origin string, page_number int, data binary",
    "layers": "id string, obj_num int, name string, visible boolean, intent array<string>, locked boolean",
    "metadata": "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string",
    "struct_elements": "path array<int>, struct_type string, title string, alt string, actual_text string, lang string, page_number int, mcids array<long>",
    "ua_issues": "issue string",
    "archive_issues": "issue string",
    "signatures": f"field_name string, signer_name string, reason string, location string, date string, sub_filter string, byte_range array<long>, contents_hex string, byte_range_valid boolean, digest string, rect {_BOX}, page_number int",
}
#: Failures that spare the rest of a document's pages.
PAGE_ONLY = {"SYNTAX", "FILTER", "UNSUPPORTED_FILTER", "FONT", "IMAGE", "CIRCULAR_REFERENCE", "OBJECT_STREAM"}
_NEEDS_COPY = {"glyphs", "spans", "lines", "paragraphs", "table_cells", "images", "attachments", "ops", "cos_objects"}


def _box(b):
    return None if b is None else dict(zip(("min_x", "min_y", "max_x", "max_y"), map(float, b)))


def _refs(x) -> list[int]:
    from .cos import Ref, Stream

    if isinstance(x, Ref):
        return [x.num]
    if isinstance(x, Stream):
        x = x.dict
    if isinstance(x, dict):
        x = list(x.values())
    return [n for v in x for n in _refs(v)] if isinstance(x, list) else []


def _kind(x) -> str:
    from .cos import Name, Ref, Stream

    for t, n in ((bool, "boolean"), (int, "integer"), (float, "real"), (Name, "name"), (bytes, "string"), (Ref, "reference"), (Stream, "stream"), (list, "array"), (dict, "dictionary")):
        if isinstance(x, t):
            return n
    return "null"


def rows(data: bytes, table: str, password: str = ""):
    """Rows (dicts) of one table of one document; raises PdfError if the document, or all of it that the table needs, can't be read. A page that fails gives no rows."""
    yield from _rows(_opened(data, password), data, table)


def _opened(data: bytes, password: str = ""):
    from . import crypto
    from .cos import Document

    doc = Document.load(data)
    if crypto.algorithm(doc):
        crypto.open_with(doc, password)
    return doc


def _rows(doc, data: bytes, table: str):
    from . import crypto, extract, fonts, layout
    from .cos import PdfError, Stream, written

    algorithm = crypto.algorithm(doc)
    if algorithm and not doc.owner and table in _NEEDS_COPY and not doc.perms & 16:
        raise PdfError("PERMISSION_DENIED", "the document does not allow copying")
    if table == "documents":
        yield {"n_pages": len(doc.pages()), "size": len(data), "encrypted": bool(algorithm), "algorithm": algorithm, "perms": doc.perms if algorithm else None}
        return
    if table == "xref":
        for num, e in sorted(doc.xref.items()):
            packed = e.kind == "compressed"
            yield {"num": num, "gen": 0 if packed else e.extra, "kind": e.kind, "offset": None if packed else e.offset, "container": e.offset if packed else None, "idx": e.extra if packed else None, "revision": e.revision}
        return
    if table == "cos_objects":
        doc.load_all()
        for num, v in sorted(doc.objects.items()):
            s = isinstance(v, Stream)
            yield {"num": num, "kind": _kind(v), "value": written(v.dict if s else v).decode("latin-1"), "stream": v.raw if s else None, "refs": _refs(v)}
        return
    whole = {"form_fields": extract.form_fields, "outlines": extract.outlines, "attachments": extract.attachments, "layers": extract.layers, "struct_elements": extract.structure, "signatures": extract.signatures}
    if table in whole:
        for r in whole[table](doc):
            yield {k: _box(v) if k == "rect" else v for k, v in r.items()}
        return
    if table in ("ua_issues", "archive_issues"):
        for issue in getattr(extract, table)(doc):
            yield {"issue": issue}
        return
    if table == "metadata":
        yield extract.metadata(doc)
        return
    pages = doc.pages()
    for i, page in enumerate(pages):
        try:
            own = list(_page_rows(doc, page, pages, i, table, extract, fonts, layout))
        except PdfError as e:
            if e.code not in PAGE_ONLY:
                raise
            continue
        for r in own:
            yield {"page_index": i, **r}


def _page_rows(doc, page, pages, i, table, extract, fonts, layout):
    from .cos import written

    if table == "pages":
        yield {"page_number": i + 1, "obj_num": page.num, "rotation": extract.rotation(doc, page), **{k: _box(b) for k, b in extract.page_boxes(doc, page).items()}}
    elif table == "annotations":
        for a in extract.annotations(doc, page, pages):
            yield a | {"rect": _box(a["rect"])}
    elif table == "form_candidates":
        from .detect import candidates

        for c in candidates(doc, i):
            yield c | {"rect": _box(c["rect"])}
    elif table == "ops":
        depth = 0
        for k, (op, args) in enumerate(layout.operations(doc.content(page))):
            depth -= op in ("Q", "ET")
            yield {"op_seq": k, "depth": max(depth, 0), "operator": op, "operands": written(args).decode("latin-1")}
            depth += op in ("q", "BT")
    elif table == "fonts":
        for f in fonts.page_fonts(doc, page).values():
            family, weight, style = f.face
            yield {"resource": f.resource, "base_font": f.base, "family": family, "weight": weight, "style": style, "is_composite": f.composite, "default_width": f.default, "widths": list(f.widths.items()), "to_unicode": list(f.to_unicode.items())}
    elif table == "fonts_embedded":
        for name, data in fonts.embedded(doc, page).items():
            yield {"resource": name, "data": data}
    else:
        s = extract.page_scan(doc, page)
        if table == "glyphs":
            for k, g in enumerate(s.glyphs):
                yield {"seq": k, "char_code": g.code, "unicode": g.text, "x": g.x, "y": g.y, "advance": g.advance, "bbox": _box(g.box), "font": g.font, "font_size": g.size, "rendered_size": g.rendered, "node": g.block}
        elif table == "segments":
            for k, (axis, p, a, b) in enumerate(s.rules):
                yield {"seq": k, "axis": axis, "pos": p, "lo": a, "hi": b}
        elif table == "images":
            for k, r in enumerate(extract.images(doc, page, s)):
                yield {"seq": k, **r, "bbox": _box(r["bbox"])}
        elif table == "scans":
            r = extract.scanned_image(doc, page, s)
            if r:
                yield {"obj_num": r["obj_num"]}
        elif table == "table_cells":
            for t, found in enumerate(layout.tables(s)):
                for r, c, b, text in found.cells:
                    yield {"table_idx": t, "row_idx": r, "col_idx": c, "row_span": 1, "col_span": 1, "bbox": _box(b), "text": text, "is_header": r == 0}
        else:
            line_id = span_id = 0
            for p, para in enumerate(layout.paragraphs(s.glyphs)):
                at = 0
                if table == "paragraphs":
                    yield {"paragraph_id": p, "text": para.text, "bbox": _box(para.box), "alignment": para.alignment, "leading": para.leading, "line_count": len(para.lines), "font": para.font, "rendered_size": para.rendered}
                for x in para.lines:
                    if table == "lines":
                        yield {"line_id": line_id, "paragraph_id": p, "text": x.text, "bbox": _box(x.box), "baseline_y": x.baseline, "start_x": x.box[0], "end_x": x.box[2], "char_start": at, "char_end": at + len(x.text)}
                    at += len(x.text) + 1
                    for sp in x.spans if table == "spans" else ():
                        yield {"span_id": span_id, "line_id": line_id, "paragraph_id": p, "text": sp.text, "bbox": _box(sp.box), "font": sp.font, "font_size": sp.size, "rendered_size": sp.rendered, "baseline_y": sp.baseline}
                        span_id += 1
                    line_id += 1


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of PDF files; the id is the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")


def _told(e: Exception) -> dict:
    return {"code": getattr(e, "code", "MALFORMED"), "message": str(e) if hasattr(e, "code") else f"{type(e).__name__}: {e}"}


#: What reading a document may raise.
_FAILS = (RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError)


def scans(files: DataFrame, tables: dict[str, str | tuple[str, str]]) -> DataFrame:
    """``files`` without content, and a column for each of ``tables`` (name -> table, or table and password): array<struct<columns of the table, status>>, what ``scan`` gives
    of the document as rows. All of them in one pass that opens a document once for each password; no shuffle brings them together."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = {name: (t, "") if isinstance(t, str) else t for name, t in tables.items()}
    kept = [c for c in files.columns if c != "content"]
    own = files.select(*kept, "content")
    out = own.drop("content").schema
    for name, (table, _) in wanted.items():
        out = out.add(name, StructType.fromDDL(f"x array<struct<{TABLES[table]}, status struct<code:string,message:string>>>")["x"].dataType)
    arrow = to_arrow_schema(out)

    def run(batches):
        from .cos import PdfError

        ok = {"code": "OK", "message": None}
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                found: dict[str, list] = {name: [] for name in wanted}
                for data in part.column(part.num_columns - 1):
                    data, docs = data.as_py() or b"", {}
                    for name, (table, password) in wanted.items():
                        held: list = []
                        try:
                            # Loading all objects hides those that can't be read, so that table has a document of its own.
                            key = (password, table == "cos_objects")
                            if key not in docs:
                                docs[key] = _opened(data, password)
                            for r in _rows(docs[key], data, table):
                                held.append({**r, "status": ok})
                        except (PdfError, *_FAILS) as e:
                            held.append({"status": _told(e)})
                        found[name].append(held)
                columns = [*part.columns[:-1], *(pa.array(v, arrow.field(name).type) for name, v in found.items())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return own.mapInArrow(run, out)


def scan(files: DataFrame, table: str, password: str = "", fail_fast: bool = False, chunk: int = 5000) -> DataFrame:
    """(doc_id, columns of the table, status struct<code, message>): rows of one table of every document.

    A document that can't be read gives one row with its status and nulls, unless ``fail_fast``. Each document is read once; a task holds one at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"doc_id string, {TABLES[table]}, status struct<code:string,message:string>"
    schema = StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else files.sparkSession.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from .cos import PdfError

        held = []
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1)):
                ok = {"code": "OK", "message": None}
                try:
                    for r in rows(data.as_py() or b"", table, password):
                        held.append({"doc_id": doc_id, **r, "status": ok})
                        if len(held) >= chunk:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                except (PdfError, *_FAILS) as e:
                    if fail_fast:
                        raise
                    held.append({"doc_id": doc_id, "status": _told(e)})
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, ddl)
