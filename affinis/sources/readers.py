"""Documents from files: plain text, word-processor files, images and PDF; PDF parsing, OCR and perceptual hashing through
functions given by the caller."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import code, tables
from affinis.functions.images import adds_text, size_of
from affinis.functions.text import ocr_accepted, ocr_text

SUPPORTED = (".txt", ".pdf", ".docx", ".png", ".jpg", ".jpeg", ".webp")
IMAGES = (".png", ".jpg", ".jpeg", ".webp")
_IMAGE = "imageId:string,pageNumber:int,filename:string,width:int,height:int,sha256:string,dhash:string,ocrRaw:string,confidence:double"
_SPEC = f"path string, filename string, extension string, sha256Hash string, text string, xml string, pages array<struct<pageNumber:int,text:string>>, images array<struct<{_IMAGE}>>, error string"

#: What a caller's PDF function may give: the text, the texts of the pages, or these and (page number, bytes) of images.
Pdf = Callable[[bytes], "str | list[str] | tuple[list[str], list[tuple[int, bytes]]]"]
#: What a caller's OCR function may give: the text, or the text and a confidence of 0 to 100.
Ocr = Callable[[bytes], "str | tuple[str, float]"]


def paragraphs_of(xml: str) -> str:
    """Raw text of WordprocessingML: each paragraph, those in table cells included, followed by an empty line."""
    out = []
    for p in re.findall(r"<w:p[\s>].*?</w:p>", xml, re.S):
        runs = re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|<w:(tab|br)(?:\s[^>]*)?/>", p, re.S)
        out.append("".join({"tab": "\t", "br": "\n"}.get(mark) or html.unescape(t) for t, mark in runs) + "\n\n")
    return "".join(out)


def _image(ident: str, page: int, name: str, data: bytes, source: str, ocr: Ocr | None, dhash: Callable[[bytes], str] | None) -> dict:
    """Fingerprint of an image; without a function for perceptual hashes the first digits of its SHA-256 stand in."""
    width, height = size_of(data) or (None, None)
    sha = sha256(data).hexdigest()
    out = {"imageId": ident, "pageNumber": page, "filename": name, "width": width, "height": height, "sha256": sha, "dhash": dhash(data) if dhash else sha[:16], "ocrRaw": None, "confidence": None}
    least = {".pdf": 120, ".docx": 100}.get(source, 0)
    if ocr and (not least or ((width or 0) >= least and (height or 0) >= 40)):
        try:
            found = ocr(data)
        except Exception:  # noqa: BLE001 - an image that can't be recognised has no text
            found = ""
        out["ocrRaw"], out["confidence"] = found if isinstance(found, tuple) else (found, None)
    return out


def extract(extension: str, name: str, data: bytes, pdf: Pdf | None = None, ocr: Ocr | None = None, dhash: Callable[[bytes], str] | None = None) -> tuple[str | None, str | None, list[dict], list[dict]]:
    """(text, markup, pages, images) of one file; raises for unsupported kinds. The text of an image is made later."""
    if extension not in SUPPORTED:
        raise ValueError(f"unsupported file type {extension or name}")
    if extension == ".txt":
        return data.decode("utf-8", "ignore"), None, [], []
    if extension == ".docx":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "ignore")
            media = [n for n in z.namelist() if n.startswith("word/media/") and n.lower().endswith(IMAGES)]
            images = [_image(f"docx_img_{i}", 1, f"docx_img_{i}.{n.rsplit('.', 1)[-1].lower()}", z.read(n), ".docx", ocr, dhash) for i, n in enumerate(media, 1)]
        return paragraphs_of(xml), xml, [], images
    if extension in IMAGES:
        return None, None, [], [_image("standalone_" + name.rsplit(".", 1)[0], 1, name, data, "", ocr, dhash)]
    if pdf is None:
        raise ValueError("no PDF extractor is given")
    got = pdf(data)
    texts, pictures = got if isinstance(got, tuple) else ([got] if isinstance(got, str) else got, [])
    seen: dict[int, int] = {}
    images = []
    for page, content in pictures:
        seen[page] = seen.get(page, 0) + 1
        images.append(_image(f"p{page}_img{seen[page]}", page, f"p{page}_img{seen[page]}.png", content, ".pdf", ocr, dhash))
    return "\n\n".join(t for t in texts if t), None, [{"pageNumber": i, "text": t or ""} for i, t in enumerate(texts, 1)], images


def _recognised(x: Column) -> Column:
    """Text recognised in an image, null where it is dropped for low confidence or blank."""
    t = ocr_text(x.ocrRaw)
    return F.when(x.ocrRaw.isNotNull() & (t != "") & ocr_accepted(t, F.coalesce(x.confidence, F.lit(100.0))), t)


def _snippet(body: Column, read: bool, image: Column, page: Column) -> Column:
    return F.struct(body.alias("code"), F.lit(read).alias("isFromOcr"), image.cast("string").alias("sourceImageId"), page.cast("int").alias("pageNumber"))


def composed(found: DataFrame) -> DataFrame:
    """Extracted parts put together: tables, then recognised texts of more than 15 characters whose beginning the text does
    not hold yet, are appended to the text; texts that are program code become code snippets.

    An image document has its recognised text, or its name, as text and only page.
    """
    c = F.col
    alone = c("extension").isin(*IMAGES)
    longest = lambda x: F.when(alone | (F.length(_recognised(x)) > 15), _recognised(x))
    shown = F.transform("images", lambda x: F.struct(x.imageId.alias("imageId"), x.pageNumber.alias("pageNumber"), x.filename.alias("filename"), x.width.alias("width"), x.height.alias("height"), x.sha256.alias("sha256"), x.dhash.alias("dhash"), longest(x).alias("ocrText")))
    out = found.withColumn("tables", tables.from_markup(c("xml"))).withColumn("images", shown)
    own = F.when(alone & c("error").isNull(), F.coalesce(c("images")[0].ocrText, F.concat(F.lit("[Image Document: "), "filename", F.lit("]")))).otherwise(F.coalesce("text", F.lit("")))
    label = lambda x: F.when(c("extension") == ".pdf", F.concat(F.lit("\n\n[OCR from Screenshot Page "), x.pageNumber.cast("string"), F.lit("]:\n"))).otherwise(F.lit("\n\n[OCR from Screenshot]:\n"))
    added = lambda acc, x: F.when(adds_text(x.ocrText, acc), F.concat(acc, label(x), x.ocrText)).otherwise(acc)
    whole = F.concat(own, tables.as_text(c("tables")))
    out = out.withColumn("text", whole).withColumn("text", F.when(alone, c("text")).otherwise(F.aggregate("images", c("text"), added)))
    read = F.transform(F.filter("images", lambda x: code.detection(x.ocrText).is_code), lambda x: _snippet(x.ocrText, True, x.imageId, x.pageNumber))
    native = F.when(~alone & code.detection(c("text")).is_code, F.array(_snippet(c("text"), False, F.lit(None), F.lit(1)))).otherwise(F.array().cast("array<struct<code:string,isFromOcr:boolean,sourceImageId:string,pageNumber:int>>"))
    pages = F.when(alone, F.array(F.struct(F.lit(1).alias("pageNumber"), c("text").alias("text")))).otherwise(c("pages"))
    scanned = (F.size("images") > 0) & ~alone & (F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) < 50)
    return out.withColumn("codeSnippets", F.concat(read, native)).withColumn("pages", pages).withColumn("hasOcr", F.exists("images", lambda x: x.ocrText.isNotNull())).withColumn("isScanned", scanned).drop("xml")


def read_documents(spark: SparkSession, path: str, pdf: Pdf | None = None, ocr: Ocr | None = None, dhash: Callable[[bytes], str] | None = None) -> DataFrame:
    """One row for each file below path: hash of its bytes, text, pages, images, tables, codeSnippets, hasOcr, isScanned, error.

    Images of PDF files of 120 x 40 pixels, of word-processor files of 100 x 40, and image documents are given to ocr. A file
    that can't be read keeps its row, with the reason in error and an empty text; no file stops the others.
    """
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", _SPEC)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for p, content in zip(files["path"], files["content"]):
                name = p.rsplit("/", 1)[-1]
                ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
                data, text, xml, pages, images, error = bytes(content), None, None, [], [], None
                try:
                    text, xml, pages, images = extract(ext, name, data, pdf, ocr, dhash)
                except Exception as e:  # noqa: BLE001
                    error = str(e)[:500]
                rows.append((p, name, ext, sha256(data).hexdigest(), text, xml, pages, images, error))
            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return composed(raw.mapInPandas(run, _SPEC))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of plain text files, read inside the engine."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_rows(stored: DataFrame, scan_id: str) -> DataFrame:
    """Rows of one scan; the filter prunes partitions of tables written by scan."""
    return stored.where(F.col("scanId") == scan_id)


def scanned_flags(pages: DataFrame, images: DataFrame) -> DataFrame:
    """documentId, pages, chars, images, sparse (mean under 30 characters a page) and scanned (under 50 in all), each only
    with images."""
    length = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    p = pages.where("documentId is not null").groupBy("documentId").agg(F.count(F.lit(1)).alias("pages"), F.sum(length).alias("chars"))
    i = images.where("documentId is not null").groupBy("documentId").agg(F.count(F.lit(1)).alias("images"))
    out = p.join(i, "documentId", "left").na.fill(0, ["images"])
    return out.select("documentId", "pages", F.col("chars").cast("long").alias("chars"), "images", ((F.col("chars") / F.col("pages") < 30) & (F.col("images") > 0)).alias("sparse"), ((F.col("chars") < 50) & (F.col("images") > 0)).alias("scanned"))
