"""Deck files: one text file for each deck, in a folder for each format, written and read by the tasks.

A file holds #main, #extra and !side, each followed by its card ids, a line for each copy. Files are put in place under their
final names, so a task that runs again writes the same files once more; _SUCCESS is written when all tasks are done, and a
folder without it is not read. A format's decks are dealt to a number of folders by id: the driver lists these alone, and
each reading task the files of its own, so that the driver's memory does not grow with the decks.

A small file takes a block of the disk and an inode. Many decks are packed instead: their files are members of compressed tar
archives, which any tar unpacks, and a list of the archives stands beside _SUCCESS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The heads of a file's sections by zone, and the name of the folder of decks without a format (fixed values).
HEADS = {"main": "#main", "extra": "#extra", "side": "!side"}
NO_FORMAT = "__HIVE_DEFAULT_PARTITION__"
SUFFIX = ".ydk"


def deck_texts(entries: DataFrame, decks: DataFrame) -> DataFrame:
    """deck_id, format, text of all decks; entries: deck_id, card_id, copies, zone. Cards come by id; a deck without entries has
    empty sections. Entries of no deck, of no card, or of another zone are left out."""
    ids = lambda zone: F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == zone, F.struct("card_id", "copies")))), lambda x: F.array_repeat(x["card_id"].cast("string"), x["copies"].cast("int")))
    parts = entries.where("card_id is not null and copies > 0").groupBy("deck_id").agg(*(F.flatten(ids(zone)).alias(zone) for zone in HEADS))
    lines = [x for zone, head in HEADS.items() for x in (F.array(F.lit(head)), F.coalesce(zone, F.array().cast("array<string>")))]
    return decks.select("deck_id", "format").join(parts, "deck_id", "left").select("deck_id", "format", F.concat(F.array_join(F.concat(*lines), "\n"), F.lit("\n")).alias("text"))


@dataclass
class Written(WriterCommitMessage):
    files: int
    archives: list[str] = field(default_factory=list)


#: Folders of a format's decks; a task reads one.
FOLDERS = 64
#: Files in a batch that goes to Spark.
BATCH = 1_000
#: Files in an archive, its ending, and the list of the archives.
PACK, PACKED, ARCHIVES = 10_000, ".tar.gz", "_ARCHIVES"


def _place(at: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(at) if ":" in at.split("/")[0] else (fs.LocalFileSystem(), at)


def _folder(name: str | None) -> str:
    return f"format={NO_FORMAT if name in (None, '') else quote(name, safe=' ')}"


class DeckWriter(DataSourceArrowWriter):
    """Writes the rows (deck_id, format, text) of a task, a file each."""

    def __init__(self, at: str, folders: int) -> None:
        self.at, self.folders = at.rstrip("/"), folders

    def write(self, iterator: Iterator) -> Written:
        import uuid

        files, at = _place(self.at)
        made, count, own = set(), 0, uuid.uuid4().hex
        for batch in iterator:
            for deck, name, text in zip(*(batch.column(c).to_pylist() for c in ("deck_id", "format", "text"))):
                if deck is None or text is None:
                    raise ValueError("a deck file needs a deck_id and a text")
                folder = f"{at}/{_folder(name)}/{deck % self.folders}"
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                rough = f"{folder}/_{deck}.{own}"
                with files.open_output_stream(rough) as out:
                    out.write(text.encode())
                files.move(rough, f"{folder}/{deck}{SUFFIX}")
                count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        files, at = _place(self.at)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        """Nothing to take back: without _SUCCESS the folder is not read, and the next try writes the same names."""


@dataclass
class Folder(InputPartition):
    at: str
    format: str | None


class PackedWriter(DeckWriter):
    """Writes the rows of a task, which come by format, as members of archives. Archives of tasks that fail are in no list."""

    def __init__(self, at: str, pack: int) -> None:
        super().__init__(at, 1)
        self.pack = pack

    def write(self, iterator: Iterator) -> Written:
        import uuid
        from contextlib import ExitStack
        from io import BytesIO
        from tarfile import TarInfo
        from tarfile import open as open_tar

        files, at = _place(self.at)
        own, done, count, inside, last = uuid.uuid4().hex, [], 0, 0, None
        with ExitStack() as opened:
            for batch in iterator:
                for deck, name, text in zip(*(batch.column(c).to_pylist() for c in ("deck_id", "format", "text"))):
                    if deck is None or text is None:
                        raise ValueError("a deck file needs a deck_id and a text")
                    folder = _folder(name)
                    if folder != last or inside == self.pack:
                        opened.close()
                        files.create_dir(f"{at}/{folder}", recursive=True)
                        done.append(f"{folder}/{own}-{len(done)}{PACKED}")
                        tar = opened.enter_context(open_tar(fileobj=opened.enter_context(files.open_output_stream(f"{at}/{done[-1]}")), mode="w|"))  # the stream compresses, by the ending
                        inside, last = 0, folder
                    data = text.encode()
                    member = TarInfo(f"{deck}{SUFFIX}")
                    member.size = len(data)
                    tar.addfile(member, BytesIO(data))
                    inside, count = inside + 1, count + 1
        return Written(count, done)

    def commit(self, messages: list) -> None:
        files, at = _place(self.at)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{ARCHIVES}") as out:
            out.write("".join(f"{x}\n" for m in messages if m for x in m.archives).encode())
        super().commit(messages)


class DeckReader(DataSourceReader):
    """deck_id, format, text of the files, a task for each folder of decks or archive."""

    def __init__(self, at: str) -> None:
        self.at = at.rstrip("/")

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        files, at = _place(self.at)
        if files.get_file_info(f"{at}/_SUCCESS").type != fs.FileType.File:
            raise FileNotFoundError(f"no finished deck files in {self.at}")
        inside = lambda folder: [x for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory]
        named = lambda name: None if name == NO_FORMAT else unquote(name)
        names = [(x.path, x.base_name.removeprefix("format=")) for x in inside(at) if x.base_name.startswith("format=")]
        packed = []
        if files.get_file_info(f"{at}/{ARCHIVES}").type == fs.FileType.File:
            with files.open_input_stream(f"{at}/{ARCHIVES}") as stream:
                packed = stream.read().decode().splitlines()
        return [Folder(f"{at}/{x}", named(x.rsplit("/", 1)[0].removeprefix("format="))) for x in packed] + [Folder(x.path, named(name)) for path, name in names for x in inside(path)]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa

        found = self._packed(partition) if partition.at.endswith(PACKED) else self._loose(partition)
        while part := list(islice(found, BATCH)):
            names, texts = [int(name.removesuffix(SUFFIX)) for name, _ in part], [text for _, text in part]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([partition.format] * len(part), pa.string()), pa.array(texts, pa.string())], ["deck_id", "format", "text"])

    def _loose(self, partition: Folder) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        files, _ = _place(self.at)
        for x in files.get_file_info(fs.FileSelector(partition.at)):
            if x.base_name.endswith(SUFFIX):
                with files.open_input_stream(x.path) as stream:
                    yield x.base_name, stream.read().decode()

    def _packed(self, partition: Folder) -> Iterator[tuple[str, str]]:
        from tarfile import open as open_tar

        files, _ = _place(self.at)
        with files.open_input_stream(partition.at) as stream, open_tar(fileobj=stream, mode="r|") as tar:
            for member in tar:
                yield member.name, tar.extractfile(member).read().decode()


class DeckFiles(DataSource):
    """df.write.format("deck_files").option("folders", 64).mode("append").save(folder); spark.read.format("deck_files").load(folder)

    With the option pack, so many decks go to an archive; rows are to come by format, and the folder must be a new one."""

    @classmethod
    def name(cls) -> str:
        return "deck_files"

    def schema(self) -> str:
        return "deck_id bigint, format string, text string"

    def writer(self, schema, overwrite: bool) -> DeckWriter:
        if overwrite:
            raise ValueError("deck files go to a new folder or take the place of those of the same decks: use mode append")
        if "pack" in self.options:
            from pyarrow import fs

            files, at = _place(self.options["path"].rstrip("/"))
            if files.get_file_info(f"{at}/_SUCCESS").type == fs.FileType.File:
                raise ValueError("packed deck files go to a new folder")
            return PackedWriter(self.options["path"], int(self.options["pack"]))
        return DeckWriter(self.options["path"], int(self.options.get("folders", FOLDERS)))

    def reader(self, schema) -> DeckReader:
        return DeckReader(self.options["path"])


def write_decks(entries: DataFrame, decks: DataFrame, at: str, folders: int = FOLDERS, pack: int | None = None) -> None:
    """A file for each deck, with so many folders a format (the same number whenever decks are written to one place), or with
    `pack` of them in an archive, in a new place. Two decks of one id are an error, as one would take the other's place."""
    spark = entries.sparkSession
    spark.dataSource.register(DeckFiles)
    one = F.assert_true(F.count(F.lit(1)) == 1, F.concat(F.lit("decks share the id "), F.col("deck_id"))).alias("fine")
    texts = deck_texts(entries, decks.groupBy("deck_id").agg(F.first("format").alias("format"), one).where("fine is null"))
    rows = texts.select(F.col("deck_id").cast("bigint").alias("deck_id"), "format", "text")
    if pack:
        rows.sortWithinPartitions("format").write.format("deck_files").option("pack", str(pack)).mode("append").save(at)
    else:
        rows.write.format("deck_files").option("folders", str(folders)).mode("append").save(at)


def section(lines: Column, zone: str) -> Column:
    """The card ids between a section's head and the next head; text that is no number is an error."""
    place = lambda head: F.array_position(lines, F.lit(head)).cast("int")
    first = place(HEADS[zone])
    later = [F.when(place(h) > first, place(h)) for h in HEADS.values()]
    end = F.coalesce(F.least(*later), F.size(lines) + 1)
    body = F.when(first > 0, F.slice(lines, first + 1, F.greatest(F.lit(0), end - first - 1)))
    return F.transform(F.filter(F.coalesce(body, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))


def read_decks(spark: SparkSession, at: str) -> DataFrame:
    """deck_id, format, zone, card_id, copies of a folder that was written to its end. Sections may come in any order; cards
    may repeat in one."""
    spark.dataSource.register(DeckFiles)
    rows = spark.read.format("deck_files").load(at).select("deck_id", "format", F.split("text", "\r?\n").alias("lines"))
    zones = F.array(*(F.struct(F.lit(z).alias("zone"), section(F.col("lines"), z).alias("ids")) for z in HEADS))
    cards = rows.select("deck_id", "format", F.inline(zones)).select("deck_id", "format", "zone", F.explode("ids").alias("card_id"))
    return cards.groupBy("deck_id", "format", "zone", "card_id").agg(F.count(F.lit(1)).alias("copies"))
