"""Page XML and other files: readers and writers.

A document is read once into a table of elements: regions of any name and at any depth, their text lines and baselines,
and the labels of its metadata, in document order. The tables of regions, lines and baselines are cuts of that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import pagetext as T

# The name space of the format and of what it refers to, and the schema's place.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"
INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
_FIELDS = [("image", pa.string()), ("page_h", pa.int32()), ("page_w", pa.int32()), ("place", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("custom", pa.string()), ("points", pa.string()), ("text", pa.string()), ("inside", pa.list_(pa.int32())), ("error", pa.string())]
ELEMENTS = "image string, page_h int, page_w int, place int, tag string, id string, custom string, points string, text string, inside array<int>, error string"


def parsed(document: str | None) -> list[tuple]:
    """The elements of one document as rows of _FIELDS: the page, its regions, text lines, baselines and metadata labels.

    `inside` are the places of the regions and the line around an element, the outermost first. A label has its type as
    id and its value as text. What cannot be read is one row with an error.
    """
    broken = lambda why: [(None, None, None, 0, None, None, None, None, None, None, why)]
    if document is None:
        return broken("no document")
    try:
        root = ElementTree.fromstring(document.encode() if document.lstrip().startswith("<?xml") else document)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        return broken(f"{type(e).__name__}: {e}")
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    strange = next((e.tag for e in root.iter() if isinstance(e.tag, str) and (e.tag[: e.tag.rfind("}") + 1] != space)), None)
    if strange is not None:
        return broken(f"unexpected name space: {strange}")
    page = root.find(f".//{space}Page")
    if page is None:
        return broken("no page")
    try:
        size = int(page.get("imageHeight", "")), int(page.get("imageWidth", ""))
    except ValueError:
        return broken("no size")
    rows, head, place = [], (page.get("imageFilename"), *size), 0
    todo = [(root, ())]
    while todo:
        e, inside = todo.pop()
        name = e.tag[len(space) :] if isinstance(e.tag, str) else ""
        own = inside
        if name == "Label":
            rows.append((*head, place, name, e.get("type"), None, None, e.get("value"), list(inside), None))
        elif name in ("Page", "TextLine", "Baseline") or name.endswith("Region"):
            at = e if name == "Baseline" else e.find(f"{space}Coords")
            first = e.find(f"{space}TextEquiv/*")
            rows.append((*head, place, name, e.get("id"), e.get("custom"), None if at is None else at.get("points"), None if first is None else first.text, list(inside), None))
            own = (*inside, place) if name != "Page" else inside
        place += 1
        todo += [(child, own) for child in reversed(e)]
    return rows


def elements(documents: DataFrame, column: str = "xml", key: str = "page_id") -> DataFrame:
    """(key, ELEMENTS) of documents (key, column)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                got = parsed(text)
                keys += [k] * len(got)
                rows += got
                if len(rows) > 1 << 16 or k == batch.num_rows - 1:
                    columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], names=[key, *(n for n, _ in _FIELDS)])
                    keys, rows = [], []

    return documents.select(key, F.col(column).cast("string").alias(column)).mapInArrow(run, f"{key} {kind}, {ELEMENTS}")


def pages_of(of: DataFrame) -> DataFrame:
    """page_id, image, page_h, page_w, error of every document."""
    return of.filter("tag = 'Page' OR error IS NOT NULL").select("page_id", "image", "page_h", "page_w", "error")


def regions_of(of: DataFrame) -> DataFrame:
    """page_id, page_h, page_w, place, tag, region_id, rtype, reading_order, pts of every region, nested ones too."""
    r = of.filter(F.col("tag").endswith("Region"))
    return r.select("page_id", "page_h", "page_w", "place", "tag", F.coalesce("id", F.lit("None")).alias("region_id"), T.region_type(F.col("custom")).alias("rtype"), T.reading_order(F.col("custom")).alias("reading_order"), _points().alias("pts"))


def lines_of(of: DataFrame) -> DataFrame:
    """page_id, page_h, page_w, place, region (the place of the innermost one, null if none), line_id, reading_order, pts, text of every text line."""
    r = of.filter("tag = 'TextLine'")
    return r.select("page_id", "page_h", "page_w", "place", F.try_element_at("inside", F.lit(-1)).alias("region"), F.coalesce("id", F.lit("None")).alias("line_id"), T.reading_order(F.col("custom")).alias("reading_order"), _points().alias("pts"), T.unit_text(F.col("text")).alias("text"))


def baselines_of(of: DataFrame) -> DataFrame:
    """page_id, page_h, page_w, place, inside, pts of every baseline with points; a single point is doubled."""
    r = of.filter("tag = 'Baseline' AND trim(points) <> ''")
    return r.select("page_id", "page_h", "page_w", "place", "inside", _points().alias("pts")).withColumn("pts", F.when(F.size("pts") == 1, F.concat("pts", "pts")).otherwise(F.col("pts")))


def class_baselines(of: DataFrame, classes: DataFrame) -> DataFrame:
    """page_id, page_h, page_w, tag, place, class_id, pts: each baseline with every region of known type around it, nested regions all."""
    known = regions_of(of).join(F.broadcast(classes.select(F.col("name").alias("rtype"), "class_id")), "rtype").select("page_id", F.col("place").alias("around"), "tag", "class_id")
    each = baselines_of(of).withColumn("around", F.explode("inside"))
    return each.join(known, ["page_id", "around"]).select("page_id", "page_h", "page_w", "tag", "around", "place", "class_id", "pts")


def confidences(of: DataFrame) -> DataFrame:
    """(page_id, confidence) of every page: its first label of that type anywhere, null if there is none or it is no number."""
    label = F.when((F.col("tag") == "Label") & (F.col("id") == "confidence"), F.struct("place", F.col("text").try_cast("double").alias("v")))
    return of.groupBy("page_id").agg(F.min(label).alias("m")).select("page_id", F.col("m.v").alias("confidence"))


def transcriptions(of: DataFrame) -> DataFrame:
    """(page_id, key, text): of every line in a TextRegion, by the ids of region and line; of equal keys the last in the document."""
    r = regions_of(of).filter("tag = 'TextRegion'").select("page_id", F.col("place").alias("around"), "region_id")
    line = of.filter("tag = 'TextLine'").select("page_id", "place", F.coalesce("id", F.lit("None")).alias("line_id"), T.unit_text(F.col("text")).alias("text"), F.explode("inside").alias("around"))
    both = line.join(r, ["page_id", "around"]).withColumn("key", F.concat_ws("_", "region_id", "line_id"))
    return both.groupBy("page_id", "key").agg(F.max_by("text", F.struct("around", "place")).alias("text"))


def checked(of: DataFrame) -> DataFrame:
    """(page_id, state): "broken" if it cannot be read, "untyped" if a region has no type, else "good"."""
    bad = F.max(F.col("tag").endswith("Region") & T.region_type(F.col("custom")).isNull())
    return of.groupBy("page_id").agg(F.max(F.col("error").isNotNull()).alias("broken"), bad.alias("untyped")).select("page_id", F.when(F.col("broken"), "broken").when(F.col("untyped"), "untyped").otherwise("good").alias("state"))


def _points() -> Column:
    """The points of an element; none if it has none."""
    return F.when(F.trim("points") != "", G.points(F.col("points")))


def _safe(text: Column, attribute: bool = True) -> Column:
    """Text within an attribute or an element, without the characters that XML does not have."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), *((('"', "quot"), ("\n", "#10"), ("\t", "#9")) if attribute else ())):
        text = F.replace(text, F.lit(c), F.lit(f"&{name};"))
    return text


def _joined(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, body): the texts of a key's rows, one after the other."""
    all_of = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(all_of, lambda r: r[text]), "").alias("body"))


def _optional(of: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in of.columns else default


def written(pages: DataFrame, regions: DataFrame, lines: DataFrame | None = None, labels: DataFrame | None = None, creator: str = "quirefold", created: Column | None = None) -> DataFrame:
    """(page_id, xml): one document for every page, also one without regions; regions in order of seq, lines of line.

    pages: page_id, w, h (image). regions: page_id, seq, pts (tag, id, rtype). lines: page_id, seq of the region, line, pts
    (baseline, text, id). labels: page_id, labels (array of type, value) of a processing step.
    """
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if created is None else created
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), _safe(value), F.lit('"'))
    shape = lambda name, pts, pad: F.concat(F.lit(f'{pad}<{name} points="'), G.point_text(pts), F.lit('"/>\n'))
    r = regions.withColumn("_tag", _optional(regions, "tag", F.lit("TextRegion"))).withColumn("_id", _optional(regions, "id", F.concat(F.lit("region_"), F.col("seq").cast("string"))))
    rtype = F.col("rtype") if "rtype" in regions.columns else F.lit(None).cast("string")
    custom = F.concat(T.order_custom(F.col("seq")), F.when(rtype.isNull(), "").otherwise(F.concat(F.lit(" "), T.type_custom(rtype))))
    inner = F.lit("")
    if lines is not None:
        base = F.when(F.size("baseline") > 0, shape("Baseline", F.col("baseline"), " " * 8)).otherwise("") if "baseline" in lines.columns else F.lit("")
        text = F.when(F.col("text").isNotNull(), F.concat(F.lit("        <TextEquiv>\n          <Unicode>"), _safe(F.col("text"), False), F.lit("</Unicode>\n        </TextEquiv>\n"))).otherwise("") if "text" in lines.columns else F.lit("")
        line_id = _optional(lines, "id", F.concat(F.lit("line_"), F.col("seq").cast("string"), F.lit("_"), F.col("line").cast("string")))
        one = F.concat(F.lit("      <TextLine"), attr("id", line_id), attr("custom", T.order_custom(F.col("line"))), F.lit(">\n"), shape("Coords", F.col("pts"), " " * 8), base, text, F.lit("      </TextLine>\n"))
        held = _joined(lines.select("page_id", "seq", "line", one.alias("x")), ["page_id", "seq"], "line", "x").withColumnRenamed("body", "inner")
        r, inner = r.join(held, ["page_id", "seq"], "left"), F.coalesce("inner", F.lit(""))
    one = F.concat(F.lit("    <"), F.col("_tag"), attr("id", F.col("_id")), attr("custom", custom), F.lit(">\n"), shape("Coords", F.col("pts"), " " * 6), inner, F.lit("    </"), F.col("_tag"), F.lit(">\n"))
    body = _joined(r.select("page_id", "seq", one.alias("x")), ["page_id"], "seq", "x")
    of = pages.join(body, "page_id", "left")
    step = F.lit("")
    if labels is not None:
        each = F.transform("labels", lambda x: F.concat(F.lit("        <Label"), attr("type", x["type"]), attr("value", x["value"]), F.lit("/>\n")))
        of = of.join(labels.select("page_id", "labels"), "page_id", "left")
        step = F.when(F.col("labels").isNotNull(), F.concat(F.lit('    <MetadataItem type="processingStep" name="layout-analysis"'), attr("value", F.lit(creator)), F.lit(">\n      <Labels>\n"), F.array_join(each, ""), F.lit("      </Labels>\n    </MetadataItem>\n"))).otherwise("")
    meta = F.concat(F.lit("  <Metadata>\n    <Creator>"), _safe(F.lit(creator), False), F.lit("</Creator>\n    <Created>"), created, F.lit("</Created>\n    <LastChange>"), created, F.lit("</LastChange>\n"), step, F.lit("  </Metadata>\n"))
    image = _optional(pages, "image", F.concat(F.col("page_id").cast("string"), F.lit(".jpg")))
    page = F.concat(F.lit("  <Page"), attr("imageFilename", image), attr("imageWidth", F.col("w").cast("string")), attr("imageHeight", F.col("h").cast("string")), F.lit(">\n"), F.coalesce("body", F.lit("")), F.lit("  </Page>\n"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<PcGts xmlns="{NAMESPACE}" xmlns:xsi="{INSTANCE}" xsi:schemaLocation="{NAMESPACE} {NAMESPACE}/pagecontent.xsd">\n'
    return of.select("page_id", F.concat(F.lit(head), meta, page, F.lit("</PcGts>\n")).alias("xml"))


def points_anywhere(documents: DataFrame, column: str, element: str) -> DataFrame:
    """(page_id, points) of every element of that name at any depth."""
    return documents.select("page_id", F.explode(F.xpath(F.col(column), F.lit(f"//{element}/@points"))).alias("points"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id, xml) of the documents under a folder, at any depth."""
    of = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml")
    return of.select(F.col("_metadata.file_path").alias("path"), T.stem(F.col("_metadata.file_path")).alias("page_id"), F.col("value").alias("xml"))


def write(documents: DataFrame, path: str) -> None:
    """One file per document, by a rename of a finished one, from the executors; `path` is a folder (or its URI) that all of them reach."""
    def run(rows) -> None:
        import uuid

        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files.create_dir(at, recursive=True)
        for row in rows:
            part = f"{at}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                f.write(row["xml"].encode())
            files.move(part, f"{at}/{row['page_id']}.xml")

    documents.select("page_id", "xml").foreachPartition(run)


def metric_lines(lines: DataFrame, column: str, names: list[str]) -> DataFrame:
    """With the named numbers of a JSON object per line as columns; null where one is not there."""
    schema = ", ".join(f"`{n}` DOUBLE" for n in names)
    return lines.withColumn("_m", F.from_json(F.col(column), schema)).select("*", *[F.col(f"_m.{n}").alias(n) for n in names]).drop("_m")
