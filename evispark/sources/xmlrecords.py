"""Records of XML files with mixed and nested content.

A file is split at the end tags of its records as it is read, so that a large export
is many tasks. Each record then goes by once as events; text is gathered around tags
inside it, and sections may lie in sections. A record that is no XML is a row with its
``error`` and stops no other.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Titles of text before the first section, and of a section without its own.
LEAD, BODY = "引言", "正文"

_QUALIFIER = pa.struct([("name", pa.string()), ("major", pa.bool_())])
_HEADING = pa.struct([("heading", pa.string()), ("ui", pa.string()), ("major", pa.bool_()), ("qualifiers", pa.list_(_QUALIFIER))])
_LIST = pa.list_(pa.string())
ARTICLE = pa.struct([
    *[(n, pa.string()) for n in ("pmid", "title", "journal", "year")], ("authors", _LIST), ("abstract", pa.string()), ("abstract_sections", pa.map_(pa.string(), pa.string())),
    *[(n, pa.string()) for n in ("doi", "pmcid", "volume", "issue", "pages", "issn")], ("pubtypes", _LIST), ("language", pa.string()),
    ("mesh", pa.list_(_HEADING)), ("mesh_major", _LIST), ("url", pa.string()), ("error", pa.string())])
SECTIONS = pa.struct([("sections", pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())]))), ("error", pa.string())])
FIGURES = pa.struct([("figures", pa.list_(pa.struct([(n, pa.string()) for n in ("label", "caption", "file", "fig_id")]))), ("error", pa.string())])

#: Where an article's plain fields are: the last two tags of their path.
_FIELDS = {
    ("MedlineCitation", "PMID"): "pmid", ("Article", "ArticleTitle"): "title", ("Journal", "Title"): "journal", ("Journal", "ISSN"): "issn", ("JournalIssue", "Volume"): "volume",
    ("JournalIssue", "Issue"): "issue", ("PubDate", "Year"): "year", ("PubDate", "MedlineDate"): "date", ("Pagination", "MedlinePgn"): "pages", ("Article", "Language"): "language"}
_IDS = {"doi": "doi", "pmc": "pmcid"}
#: Bytes of XML whose records are Python objects at once.
SLICE = 1 << 20


def records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``xml``: each element ``tag`` of the files as text. Elements of a tag must not lie in one another."""
    parts = spark.read.option("lineSep", f"</{tag}>").text(path)
    start = F.regexp_extract("value", rf"(?s).*(<{tag}(?:\s[^>]*)?>.*)$", 1)
    return parts.select(F.concat(start, F.lit(f"</{tag}>")).alias("xml")).where(F.col("xml") != f"</{tag}>")


def _events(xml: str) -> Iterator[tuple[str, list[str], ET.Element]]:
    """``start`` and ``end`` of each element with the path of tags to it, itself last; without namespaces."""
    path: list[str] = []
    for event, element in ET.iterparse(io.BytesIO(xml.encode("utf-8", "surrogatepass")), ("start", "end")):
        if event == "start":
            path.append(element.tag.rpartition("}")[2])
            yield event, path, element
        else:
            yield event, path, element
            path.pop()


def _text(element: ET.Element, between: str = "") -> str:
    return between.join(element.itertext()).strip()


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _attribute(element: ET.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), "")


def article(xml: str) -> dict:
    """Fields of one article record; see :func:`articles`."""
    plain: dict[str, str] = {}
    authors, parts, labelled, types, mesh = [], [], {}, [], []
    author: dict[str, str] = {}
    for event, path, e in _events(xml):
        if event == "start":
            if path[-1] == "Author":
                author = {}
            elif path[-1] == "MeshHeading":
                mesh.append({"heading": "", "ui": "", "major": False, "qualifiers": []})
            continue
        at, tag = tuple(path[-2:]), path[-1]
        if at in _FIELDS:
            plain.setdefault(_FIELDS[at], _text(e))
        elif at[0] == "Author" and tag in ("LastName", "Initials", "CollectiveName"):
            author.setdefault(tag, (e.text or "").strip())
        elif at == ("AuthorList", "Author"):
            name = f"{author['LastName']} {author.get('Initials', '')}".strip() if author.get("LastName") else author.get("CollectiveName", "")
            authors += [name] if name else []
        elif at == ("Abstract", "AbstractText") and (text := _text(e)):
            label = (e.get("Label") or e.get("NlmCategory") or "").strip()
            parts.append(f"{label}: {text}" if label else text)
            if label:
                labelled.setdefault(label.upper().rstrip(":：").strip(), []).append(text)
        elif at == ("ArticleIdList", "ArticleId") and "ReferenceList" not in path and e.get("IdType") in _IDS:
            plain[_IDS[e.get("IdType")]] = (e.text or "").strip()
        elif at == ("PublicationTypeList", "PublicationType") and (text := _text(e)):
            types.append(text)
        elif at[0] == "MeshHeading" and tag in ("DescriptorName", "QualifierName") and (name := (e.text or "").strip()):
            major = e.get("MajorTopicYN") == "Y"
            if tag == "DescriptorName":
                mesh[-1].update(heading=name, ui=(e.get("UI") or "").strip(), major=major)
            else:
                mesh[-1]["qualifiers"].append({"name": name, "major": major})
    mesh = [m for m in mesh if m["heading"]]
    out = {n: plain.get(n) or None for n in ("pmid", "journal", "doi", "pmcid", "volume", "issue", "pages", "issn", "language")}
    return out | {"title": _squeezed(plain.get("title", "")), "year": plain.get("year") or plain.get("date") or None, "authors": authors, "abstract": "\n".join(parts),
                  "abstract_sections": [(k, " ".join(v)) for k, v in labelled.items()], "pubtypes": types, "mesh": mesh, "mesh_major": [m["heading"] for m in mesh if m["major"]],
                  "url": f"https://pubmed.ncbi.nlm.nih.gov/{plain['pmid']}/" if plain.get("pmid") else "", "error": None}


def sections(xml: str) -> dict:
    """Sections of one full text; see :func:`fulltexts`."""
    lead, found, every = [], [], []
    places: dict[int, list[list[str]]] = {}  # an open paragraph's places in the lists it belongs to
    body, done, title, own = None, False, "", []
    for event, path, e in _events(xml):
        tag = path[-1]
        if done:
            break
        if body is None:
            if event == "start" and tag == "body":
                body = len(path)
            continue
        depth = len(path) - body
        if event == "start":
            if tag == "sec" and depth == 1:
                title, own = "", []
            elif tag == "p":
                slots = [every] + ([own] if path[body:body + 1] == ["sec"] else [])
                places[id(e)] = [[slot, len(slot)] for slot in slots]
                for slot in slots:
                    slot.append("")
            continue
        if tag == "p":
            for slot, at in places.pop(id(e)):
                slot[at] = _text(e, " ")
            if depth == 1 and not found and lead is not None:
                lead.append(_squeezed(_text(e)))
        elif tag == "title" and depth == 2 and path[body] == "sec" and not title:
            title = _text(e)
        elif tag == "sec" and depth == 1:
            found.append((title or BODY, _squeezed(" ".join(own))))
        elif depth == 0:
            done = True
    head = " ".join(x for x in lead if x)
    out = ([(LEAD, head)] if head else []) + [x for x in found if x[1]]
    whole = _squeezed(" ".join(every))
    return {"sections": [{"title": t, "text": x} for t, x in out or ([(BODY, whole)] if whole else [])], "error": None}


def figures(xml: str) -> dict:
    """Figures of one full text; see :func:`figure_rows`."""
    out, open_ = [], []
    for event, path, e in _events(xml):
        tag = path[-1]
        if event == "start":
            if tag == "fig":
                open_.append({"label": "", "caption": None, "file": None, "fig_id": e.get("id") or ""})
                out.append(open_[-1])
            elif tag == "graphic":
                for fig in open_:
                    if fig["file"] is None:
                        fig["file"] = _attribute(e, "href") or e.get("id") or ""
        elif open_ and tag == "fig":
            open_.pop()
        elif open_ and path[-2] == "fig":
            if tag == "label" and not open_[-1]["label"]:
                open_[-1]["label"] = (e.text or "").strip()
            elif tag == "caption" and open_[-1]["caption"] is None:
                open_[-1]["caption"] = _text(e)
    return {"figures": [f | {"caption": f["caption"] or ""} for f in out if f["file"]], "error": None}


def _slices(batch: pa.RecordBatch, xml: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE`` bytes of XML, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(xml)).to_pylist()):
        if i > start and size + (n or 0) > SLICE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def parsed(df: DataFrame, read: Callable[[str], dict], kind: pa.StructType, xml: str = "xml", into: str = "parsed") -> DataFrame:
    """``df`` without its column ``xml`` and with a struct ``into`` that ``read`` makes of it; null XML gives a null struct.

    A batch has as many rows as Spark sends; only a run of them is held as Python objects.
    """
    rest = [c for c in df.columns if c != xml]
    target = pa.schema([*to_arrow_schema(df.select(*[f"`{c}`" for c in rest]).schema), pa.field(into, kind)])

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            return read(text)
        except ET.ParseError as e:
            return {"error": str(e)[:200]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, xml):
                made = pa.array([one(x.as_py()) for x in part.column(xml)], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], made], [*rest, into])

    return df.mapInArrow(run, from_arrow_schema(target))


def articles(df: DataFrame, xml: str = "xml", into: str = "article") -> DataFrame:
    """Article records in ``xml`` as a struct ``into``.

    Text around inline tags is joined. Authors are last name and initials, else a group's
    name. Parts of the abstract that have a label (else a category) begin with it; parts
    of one label are joined in ``abstract_sections``. Ids of references are not the
    article's. Fields that are not there are null, title, abstract and lists empty.
    """
    return parsed(df, article, ARTICLE, xml, into)


def fulltexts(df: DataFrame, xml: str = "xml", into: str = "fulltext") -> DataFrame:
    """Full texts in ``xml`` as a struct of ``sections(title, text)`` and ``error``.

    The paragraphs of the body before its first section are ``LEAD``; a section on top has
    all paragraphs in it, however deep; one without a title is ``BODY``, one without text
    is left out. A body without sections and lead is one section of all its paragraphs.
    White space is squeezed; text at both sides of an inline tag is joined by a space.
    """
    return parsed(df, sections, SECTIONS, xml, into)


def figure_rows(df: DataFrame, xml: str = "xml", into: str = "figures") -> DataFrame:
    """Full texts in ``xml`` as a struct of ``figures(label, caption, file, fig_id)`` and ``error``; figures without a graphic are left out."""
    return parsed(df, figures, FIGURES, xml, into)
