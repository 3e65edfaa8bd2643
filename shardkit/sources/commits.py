"""A log of numbered versions, each created only if absent, so that writers notice one another.

A version is a small JSON file. Whoever creates number n + 1 has seen version n; who comes
second finds the number taken, reads the new version and tries again. This needs a file system in
which a name can be given only once: the local one, by a link, or one whose rename refuses an existing target.
"""

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# A writer gives up when others were faster this many times in a row.
MOST_TRIES = 100


def file_system(spark: SparkSession, path: str):
    """(qualified path, its file system) in the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(target), system


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory; none if it does not exist."""
    target, system = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    target, system = file_system(spark, path)
    system.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    target, system = file_system(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in place of an older one."""
    target, system = file_system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with all its content at once; False if there is one already."""
    jvm = spark._jvm
    target, system = file_system(spark, path)
    system.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    write_text(spark, draft.toString(), text)
    try:
        if system.getScheme() == "file":
            no_more = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            link, source = (jvm.java.nio.file.Paths.get(p.toUri().getPath(), no_more) for p in (target, draft))
            jvm.java.nio.file.Files.createLink(link, source)
        else:
            _rename(spark, draft, target)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            return False
        raise
    finally:
        system.delete(draft, False)


def _rename(spark: SparkSession, draft, target) -> None:
    """Rename unless the target exists, decided by the file system."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    context.rename(draft, target, options)


class CommitLog:
    """Versions 1, 2, … below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:012d}.json"

    def head(self) -> tuple[int, dict]:
        """The newest version and its content; (0, {}) before the first."""
        found = [n for n in names(self.spark, self.path) if n.endswith(".json") and not n.startswith(".")]
        if not found:
            return 0, {}
        version = int(found[-1].split(".")[0])
        return version, json.loads(read_text(self.spark, self._file(version)))

    def commit(self, change: Callable[[int, dict], dict]) -> int:
        """Create the next version from the newest one, again if another writer was faster; returns its number.

        `change` gets the newest version and returns the content of the next. What it raises ends the call.
        """
        for _ in range(MOST_TRIES):
            version, content = self.head()
            if put_if_absent(self.spark, self._file(version + 1), json.dumps(change(version, content))):
                return version + 1
        raise RuntimeError(f"others were faster {MOST_TRIES} times: {self.path}")
