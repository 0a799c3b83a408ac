"""Message files -> messages table (SRC1-SRC4, FN20-FN32, PRT8-PRT10, AGG21).

Folders are walked and files listed and read on the executors, so names with ':' and folders whose names
begin with '.' are read like others. The MIME parse runs in ``mapInPandas`` with the Python standard
``email`` package, Arrow batch by Arrow batch. The per-message helper only
walks the MIME tree; everything after it (priority, lists, tags, references, threading, contacts, search) is
DataFrame work.
"""

from __future__ import annotations

import datetime as dt
import email
import email.errors
import email.header

import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flags import flags_from_path, maildir_from_path
from ..functions.people import mailing_list, parse_prio, tags_from_headers
from ..operators.ordering import merge_refs
from ..schema import CONTACT, FLAG_BITS

MAILDIR_FILE = r"/(cur|new)/[^/]+$"
# bytes of messages that a Python worker holds at once (one larger message is held alone)
CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 500


def cap_size(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """SRC2: drop files over a size cap, if the caller names one."""
    return files if max_bytes is None else files.where(F.col("size") <= max_bytes)


def _fs_for(path: str):
    """pyarrow filesystem and in-filesystem path for a local path or a URI."""
    from pyarrow import fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _ancestor_dirs(path_col: str = "path"):
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def marker_dirs(files: DataFrame, full: bool = False) -> DataFrame:
    """Directories (ancestors of the listed files) holding a .noindex marker, or
    .noupdate unless this is a full index, for listings that another reader made (the stream's):
    each distinct directory is checked on the executors (pyarrow filesystem)."""
    names = [".noindex"] if full else [".noindex", ".noupdate"]
    dirs = files.select(F.explode(_ancestor_dirs()).alias("dir")).distinct()

    def check(it):
        from pyarrow import fs as pafs
        for pdf in it:
            keep = []
            for d in pdf["dir"]:
                filesystem, base = _fs_for(d)
                infos = filesystem.get_file_info([base.rstrip("/") + "/" + n for n in names])
                if any(i.type != pafs.FileType.NotFound for i in infos):
                    keep.append(d)
            yield pd.DataFrame({"dir": keep}, dtype=object)
    return dirs.mapInPandas(check, "dir string")


def exclude_dirs(files: DataFrame, markers: DataFrame) -> DataFrame:
    """SRC3: drop files below a marker directory: an anti join on the exploded ancestor directories."""
    ex = files.select("path", F.explode(_ancestor_dirs()).alias("dir"))
    hit = ex.join(markers, "dir", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


PARSED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("size", T.LongType()),
    T.StructField("sha", T.StringType()),
    T.StructField("msgid", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("cc", T.StringType()),
    T.StructField("bcc", T.StringType()),
    T.StructField("contacts", T.ArrayType(CONTACT)),
    T.StructField("content_flags", T.IntegerType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("body_html", T.StringType()),
    T.StructField("embedded_text", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("cid", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]))),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])

_ID_RX = re.compile(r"<([^<>]+)>")
# what a display name can't hold unquoted
_QUOTED_RX = re.compile(r'[][\\()<>@,:;".]')


def _ids(value) -> list[str]:
    return _ID_RX.findall(str(value or ""))


def _plain(value: str) -> str:
    """The string without lone surrogates, which some charsets decode to and no table can hold."""
    return value.encode("utf-8", "replace").decode("utf-8")


def _decode(value) -> str | None:
    """Header value with RFC 2047 encoded words decoded; raw bytes and unknown charsets become replacement characters."""
    if value is None:
        return None
    try:
        return _plain(str(email.header.make_header(email.header.decode_header(str(value)))))
    except (ValueError, LookupError, TypeError, email.errors.MessageError):
        return _plain(str(value))


def _text_of(part) -> str:
    payload = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8"):
        try:
            return _plain(payload.decode(charset, "replace"))
        except (ValueError, LookupError):  # not a charset, or one that can't replace
            continue
    return ""


def _addresses(values: list) -> Iterator[tuple[str | None, str]]:
    """(name, address) of each mailbox. A header is parsed as it is written and its names are decoded after, so that an encoded comma
    parts nothing; a malformed entry costs no other one."""
    for value in values:
        for name, addr in email.utils.getaddresses([str(value)], strict=False):
            if addr:
                yield _decode(name) or None, _plain(addr)


def _mailbox(name: str | None, addr: str) -> str:
    if not name:
        return addr
    return f'"{email.utils.quote(name)}" <{addr}>' if _QUOTED_RX.search(name) else f"{name} <{addr}>"


def _params(node) -> dict[str, str]:
    """Content-type parameters, those of RFC 2231 (charset, language, value) decoded."""
    return {_plain(k.lower()): _plain(email.utils.collapse_rfc2231_value(v)) for k, v in (node.get_params() or [])[1:]}


def _nodes(msg) -> Iterator:
    """The MIME tree in order. An attached message is one node: what it holds is its own."""
    yield msg
    if msg.is_multipart() and msg.get_content_maintype() != "message":
        for part in msg.get_payload():
            yield from _nodes(part)


def _is_leaf(node) -> bool:
    return not node.is_multipart() or node.get_content_maintype() == "message"


def _payload(part) -> bytes:
    """Decoded bytes of a leaf; of an attached message, its source."""
    if part.is_multipart():
        return b"\n".join(p.as_bytes() for p in part.get_payload())
    return part.get_payload(decode=True) or b""


def _embedded(part) -> list[str]:
    """Searchable text of an attached part: plain text; of a message, sender, subject, recipients and plain texts."""
    if not part.is_multipart():
        return [_text_of(part)] if part.get_content_maintype() == "text" else []
    out = []
    for inner in part.get_payload():
        named = [inner.get("from"), inner.get("subject"), *(v for h in ("to", "cc", "bcc") for v in inner.get_all(h, []))]
        out += [_decode(v) for v in named if v]
        for node in _nodes(inner):
            if node.get_content_type() == "message/rfc822" or (_is_leaf(node) and node.get_content_type() == "text/plain"):
                out += _embedded(node)
    return out


def _counts_as_attachment(ctype: str, disposition: str | None) -> bool:
    """AGG21: parts with a disposition, but for inline bodies and signatures."""
    main, _, sub = ctype.partition("/")
    if disposition is None or disposition == "attachment":
        return disposition is not None
    return (main in ("image", "audio", "application", "text") and sub != "pgp-signature"
            and ctype not in ("text/plain", "text/html"))


def parse_one(path: str, content: bytes) -> dict:
    """Headers, contacts and parts of one RFC 822 message (compat32 parser: the
    fast path of the standard package; headers decoded explicitly)."""
    msg = email.message_from_bytes(content)
    headers = {_plain(k.lower()): _decode(v) for k, v in reversed(msg.items())}  # of repeated headers, the first
    mid = _ids(msg.get("message-id"))
    date = None
    if msg.get("date"):
        try:
            d = email.utils.parsedate_to_datetime(str(msg.get("date")))
            date = d.astimezone(dt.timezone.utc).replace(tzinfo=None) if d.tzinfo else d
        except (TypeError, ValueError, IndexError, OverflowError):
            date = None
    contacts = []
    for ctype in ("from", "to", "cc", "bcc", "reply-to"):
        for name, addr in _addresses(msg.get_all(ctype, [])):
            contacts.append({"type": ctype.replace("-", ""), "name": name, "email": addr, "full_address": _mailbox(name, addr)})
    parts, texts, htmls, embedded = [], [], [], []
    flags = 0
    for node in _nodes(msg):
        ctype = node.get_content_type()
        if not _is_leaf(node):
            flags |= {"multipart/signed": FLAG_BITS["z"], "multipart/encrypted": FLAG_BITS["x"]}.get(ctype, 0)
            continue
        disp = node.get_content_disposition()
        if _counts_as_attachment(ctype, disp):
            flags |= FLAG_BITS["a"]
        if ctype in ("text/plain", "text/html") and disp != "attachment":
            (texts if ctype == "text/plain" else htmls).append(_text_of(node))
        else:
            embedded += _embedded(node)
        parts.append({"index": len(parts) + 1, "mime_type": ctype, "size": len(_payload(node)), "disposition": disp,
                      "filename": _decode(node.get_filename()), "cid": _plain(str(node.get("content-id") or "")).strip("<> ") or None,
                      "charset": node.get_content_charset(), "params": _params(node)})

    def disp_of(t):
        return ", ".join(c["name"] or c["email"] for c in contacts if c["type"] == t) or None

    return {"path": path, "msgid": mid[0] if mid else None,
            "subject": headers.get("subject"), "date": date, "from": disp_of("from"), "to": disp_of("to"),
            "cc": disp_of("cc"), "bcc": disp_of("bcc"), "contacts": contacts, "content_flags": flags,
            "body_text": "\n".join(texts) if texts else None, "body_html": "\n".join(htmls) if htmls else None,
            "embedded_text": "\n".join(embedded) if embedded else None, "parts": parts, "headers": headers}


def parse_safely(path: str, content: bytes) -> dict:
    """``parse_one``, or a row with the reason in ``error``: a message that can't be parsed doesn't end a job."""
    try:
        return parse_one(path, content) | {"error": None}
    except Exception as e:  # whatever the standard package raises on what strangers send
        return dict.fromkeys(PARSED.names) | {"path": path, "contacts": [], "content_flags": 0, "parts": [], "headers": {}, "error": _plain(f"{type(e).__name__}: {e}")}


def _chunks(rows: Iterator[dict], weight, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of up to CHUNK_BYTES by ``weight`` and CHUNK_ROWS rows, or of one row."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size >= CHUNK_BYTES or len(held) >= CHUNK_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _parse_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib
    cols = [f.name for f in PARSED.fields]

    def rows(pdf: pd.DataFrame) -> Iterator[dict]:
        for p, mt, sz, c in zip(pdf["path"], pdf["mtime"], pdf["size"], pdf["content"]):
            raw = bytes(c)
            yield parse_safely(p, raw) | {"mtime": mt, "size": int(sz), "sha": hashlib.sha256(raw).hexdigest()}

    for pdf in it:
        yield from _chunks(rows(pdf), lambda r: r["size"], cols)


def parse_messages(files: DataFrame, root: str | None = None) -> DataFrame:
    """SRC4: files (path, mtime, size, content) -> messages.

    msgid falls back to '<sha256 of content>@postlake' (FN31); flags combine the
    file name (FN20), the content (AGG21) and the list; thread_id is THR1. A message that can't be parsed
    has a row with its path, size and stamp and the reason in ``error``, which is null for all others.
    """
    j = files.select("path", "mtime", "size", "content").mapInPandas(_parse_batches, PARSED)
    msgid = F.when(F.col("msgid").isNotNull() & (F.octet_length("msgid") < 240), F.col("msgid")).otherwise(
        F.concat(F.col("sha"), F.lit("@postlake")))
    h = lambda name: F.try_element_at("headers", F.lit(name))
    ids = lambda name: F.regexp_extract_all(F.coalesce(h(name), F.lit("")), F.lit(r"<([^<>]+)>"), F.lit(1))
    on_list = F.when(F.col("mailing_list").isNotNull(), F.lit(FLAG_BITS["l"])).otherwise(F.lit(0))
    out = (j.withColumn("mailing_list", mailing_list(h("list-id"), h("x-feed2imap-version"), "msgid"))
           .withColumn("msgid", msgid)
           .withColumns({"prio": parse_prio(h("precedence"), h("x-priority"), h("importance")),
                         "tags": tags_from_headers(h("x-label"), h("x-keywords"), h("keywords")),
                         "refs": merge_refs(ids("references"), ids("in-reply-to"))})
           .withColumn("flags", flags_from_path("path").bitwiseOR(F.col("content_flags")).bitwiseOR(on_list).cast("int"))
           .withColumn("thread_id", F.coalesce(F.try_element_at("refs", F.lit(1)), F.col("msgid")))
           .withColumn("files", F.filter(F.transform("parts", lambda p: p["filename"]), lambda x: x.isNotNull()))
           .withColumn("mimes", F.transform("parts", lambda p: p["mime_type"]))
           .drop("content_flags", "sha"))
    if root is not None:
        out = out.withColumn("maildir", maildir_from_path("path", re.sub(r"^file:/*", "/", root)))
    return out.withColumn("doc_id", F.xxhash64("path"))


def write_files(files: DataFrame, root: str) -> int:
    """Write (relpath, content) rows as files below ``root`` from the executors
    (pyarrow's filesystem layer: local, HDFS or object stores)."""
    def write_part(rows):
        filesystem, base = _fs_for(root)
        made = set()
        for r in rows:
            target = base.rstrip("/") + "/" + r["relpath"].lstrip("/")
            d = target.rsplit("/", 1)[0]
            if d not in made:
                filesystem.create_dir(d, recursive=True)
                made.add(d)
            with filesystem.open_output_stream(target) as out:
                out.write(bytes(r["content"]))
    files.select("relpath", "content").foreachPartition(write_part)
    return 0


PART_PAYLOAD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("msgid", T.StringType()),
    T.StructField("part_index", T.IntegerType()),
    T.StructField("mime_type", T.StringType()),
    T.StructField("disposition", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def part_payloads(files: DataFrame) -> DataFrame:
    """SNK7 input: one row per leaf part with its decoded payload (executor side)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [f.name for f in PART_PAYLOAD.fields]

        def rows(pdf: pd.DataFrame) -> Iterator[dict]:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    msg = email.message_from_bytes(bytes(content))
                    mid = _ids(msg.get("message-id"))
                    leaves = [{"path": path, "msgid": mid[0] if mid else None, "part_index": idx,
                               "mime_type": part.get_content_type(), "disposition": part.get_content_disposition(),
                               "filename": _decode(part.get_filename()), "payload": _payload(part)}
                              for idx, part in enumerate(filter(_is_leaf, _nodes(msg)), 1)]
                except Exception:  # as in parse_safely; such a message has no parts to export
                    continue
                yield from leaves

        for pdf in it:
            yield from _chunks(rows(pdf), lambda r: len(r["payload"]), cols)
    return files.select("path", "content").mapInPandas(run, PART_PAYLOAD)


# --- listing and reading on the executors ---

def _list_children(fs_path: str):
    """(entries, path in its file system) of a folder; no entries where there is no such folder."""
    from pyarrow import fs as pafs
    filesystem, base = _fs_for(fs_path)
    try:
        return filesystem.get_file_info(pafs.FileSelector(base, recursive=False)), base
    except (FileNotFoundError, NotADirectoryError):
        return [], base


FOLDER_ROW = T.StructType([
    T.StructField("dir", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("cur", T.LongType()),
    T.StructField("new", T.LongType()),
])
# folders that a task lists before it hands on what is below them
WALK_STEP = 500


def local_root(root: str) -> str:
    return re.sub(r"^file:/*", "/", root) if root.startswith("file:") else root


def markers_of(full: bool) -> set[str]:
    return {".noindex"} if full else {".noindex", ".noupdate"}


def walk_from(dirs: list[str], markers: set[str], most: int | None = None) -> Iterator[tuple]:
    """Rows of FOLDER_ROW for the trees below ``dirs``, breadth first; after ``most`` listings, the rest as kind ``dir``.

    kind ``maildir``: holds cur or new, whose own modification times in ns are in those columns (null where there is none, or
    the file system keeps none for folders). ``marked``: a marker is in it, and it isn't entered. ``failed``: it can't be listed.
    """
    from collections import deque

    from pyarrow import fs as pafs
    todo = deque(dirs)
    while todo and (most is None or most > 0):
        d, most = todo.popleft(), most - 1 if most is not None else None
        filesystem, base = _fs_for(d)
        try:
            infos = {i.base_name: i for i in filesystem.get_file_info(pafs.FileSelector(base, recursive=False))}
        except OSError:
            yield d, "failed", None, None
            continue
        if markers & set(infos):
            yield d, "marked", None, None
            continue
        stamps = [infos[k].mtime_ns if k in infos and infos[k].type == pafs.FileType.Directory else None for k in ("cur", "new")]
        if any(k in infos and infos[k].type == pafs.FileType.Directory for k in ("cur", "new")):
            yield d, "maildir", *stamps
        todo.extend(d.rstrip("/") + "/" + name for name, i in infos.items()
                    if i.type == pafs.FileType.Directory and name not in ("cur", "new", "tmp"))
    for d in todo:
        yield d, "dir", None, None


def walk_folders(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """Folders below root as rows of FOLDER_ROW (kinds maildir, marked, failed), found by a breadth-first walk whose
    frontier is a DataFrame listed on the executors. Subtrees with a .noindex marker (and .noupdate unless
    ``full``) are not entered (SRC3). Only the frontier's size is counted on the driver. A root that can't be listed is an error."""
    markers = markers_of(full)

    def expand(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame(list(walk_from(pdf["dir"].tolist(), markers, WALK_STEP)), columns=FOLDER_ROW.names).astype({"cur": "Int64", "new": "Int64"})

    top = local_root(root)
    frontier, found = spark.createDataFrame([(top,)], "dir string"), None
    n = max(1, spark.sparkContext.defaultParallelism)
    while True:
        step = checkpoint_df((frontier if found is None else frontier.repartition(n, "dir")).mapInPandas(expand, FOLDER_ROW))
        if found is None and not step.where((F.col("kind") == "failed") & (F.col("dir") == top)).isEmpty():
            raise FileNotFoundError(f"{root}: not a folder that can be listed")
        own = step.where("kind <> 'dir'")
        found = own if found is None else found.unionByName(own)
        frontier = step.where("kind = 'dir'").select("dir")
        if frontier.isEmpty():
            return found


def list_folders(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """Directories below root that hold a cur/ or new/ folder (SRC1, SRC3)."""
    return walk_folders(spark, root, full).where("kind = 'maildir'").select("dir")


def checkpoint_df(df: DataFrame) -> DataFrame:
    from ..session import checkpointed
    return checkpointed(df)


FILE_ROW = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("size", T.LongType()),
])


def list_files(folders: DataFrame, full: bool = False) -> DataFrame:
    """Files directly inside each folder's cur/ and new/ (executor-side listing), but for one that holds a marker itself."""
    return list_message_dirs(folders.select(F.explode(F.array(F.concat("dir", F.lit("/cur")), F.concat("dir", F.lit("/new")))).alias("folder")), full).where(
        "kind = 'file'").select(FILE_ROW.names)


LISTED = T.StructType([T.StructField("folder", T.StringType()), T.StructField("kind", T.StringType()), *FILE_ROW.fields])


def list_message_dirs(folders: DataFrame, full: bool = False) -> DataFrame:
    """For each ``folder`` (a cur or new), rows of kind ``file``; or one row of kind ``kept`` if it holds a marker or can't be
    listed, so that nothing is known of its files. A folder that is gone has no rows."""
    markers = markers_of(full)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        for pdf in it:
            for folder in (d.rstrip("/") for d in pdf["folder"]):
                try:
                    infos = _list_children(folder)[0]
                except OSError:
                    infos = None
                if infos is None or markers & {i.base_name for i in infos}:
                    rows = [(folder, "kept", None, None, None)]
                else:
                    rows = [(folder, "file", folder + "/" + i.base_name, i.mtime.replace(tzinfo=None) if i.mtime is not None else None, int(i.size))
                            for i in infos if i.type == pafs.FileType.File]
                yield pd.DataFrame(rows, columns=LISTED.names).astype({"size": "Int64"})
    return folders.select("folder").mapInPandas(run, LISTED)


def read_files(files: DataFrame) -> DataFrame:
    """(path, mtime, size) -> plus content, read on the executors. A file that can't be read, or is gone by then, has no
    row, and a later run finds it again."""
    schema = T.StructType(FILE_ROW.fields + [T.StructField("content", T.BinaryType())])

    def run(it):
        def rows(pdf: pd.DataFrame) -> Iterator[dict]:
            for p, mt, size in zip(pdf["path"], pdf["mtime"], pdf["size"]):
                filesystem, base = _fs_for(p)
                try:
                    with filesystem.open_input_stream(base) as fh:
                        content = fh.read()
                except OSError:
                    continue
                yield {"path": p, "mtime": mt, "size": size, "content": content}

        for pdf in it:
            yield from _chunks(rows(pdf), lambda r: len(r["content"]), schema.names)
    return files.select(FILE_ROW.names).mapInPandas(run, schema)


def list_maildir(spark: SparkSession, root: str, max_bytes: int | None = None, full: bool = False,
                 num_partitions: int | None = None) -> DataFrame:
    """SRC1-SRC3: (path, mtime, size) of every regular file in a cur/ or new/ folder below root, without
    marked subtrees; folders are walked and files listed on the executors."""
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = list_folders(spark, root, full)
    return cap_size(list_files(folders.repartition(n, "dir"), full), max_bytes)


def scan_maildir(spark: SparkSession, root: str, max_bytes: int | None = None,
                 full: bool = False, num_partitions: int | None = None) -> DataFrame:
    """SRC1-SRC3 with the files' bytes, read on the executors; files are spread by a hash of the path."""
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_files(list_maildir(spark, root, max_bytes, full, n).repartition(n, "path"))


def index_maildir(spark: SparkSession, root: str, max_size: int | None = None, full: bool = False) -> DataFrame:
    """SRC1-SRC4 composed: walk, list, cap, read, parse."""
    return parse_messages(scan_maildir(spark, root, max_size, full), root)


# one path reads archives of any size; the names say so where that matters
scan_maildir_distributed, index_maildir_distributed = scan_maildir, index_maildir
