"""State that outlives a run: a folder on storage that all executors share.

Small files are created once, whole, by a rename that fails where the name is taken; of several writers at once one
wins. A run writes its outputs under names of its own and then claims the next number among the manifests; until that
claim nothing that readers follow has changed, and a run that dies before it leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

TAKEN = "FileAlreadyExistsException"


class Store:
    """One folder, reached by Hadoop's file systems as Spark reaches its tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _path(self, name: str) -> JavaObject:
        return self._hadoop.Path(self.at(name) if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Sorted names of the visible entries of a folder; none if it isn't there."""
        if not self.exists(folder):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))
        return sorted(n for n in found if n[0] not in "._")

    def text(self, name: str) -> str | None:
        """A small file's text, None if it isn't there."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Creates a small file with its whole text, unless it is there; tells whether this call did."""
        folder, _, own = name.rpartition("/")
        target, draft = self._path(name), self._path(f"{folder}/.{own}-{uuid.uuid4().hex}".lstrip("/"))
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft)
        out.write(text.encode())
        out.close()
        try:
            self._rename(draft, target)
        except Py4JJavaError as refused:
            if TAKEN not in str(refused.java_exception):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def _rename(self, draft: JavaObject, target: JavaObject) -> None:
        """Fails if the target exists. A local rename would replace it, so there the file gets its second name by a link."""
        jvm = self.spark._jvm
        if self._fs.getUri().getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark._sc._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(place(target), place(draft))
            return
        kind = getattr(self._hadoop, "Options$Rename")
        never = self.spark._sc._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, never)

    # --- manifests

    def head(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and nothing before the first."""
        numbers = self.names("manifests")
        return (int(numbers[-1].split(".")[0]), json.loads(self.text(f"manifests/{numbers[-1]}"))) if numbers else (0, {})

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Publishes ``change`` of the newest manifest; where another run came first, the change is made to what that run left."""
        while True:
            number, now = self.head()
            new = change(now)
            if self.claim(f"manifests/{number + 1:08d}.json", json.dumps(new, sort_keys=True)):
                return new


def fixed_universe(store: Store, describe: Callable[[], DataFrame]) -> DataFrame:
    """The universe of the first run on this store; ``describe`` gives this run's, which counts only if there is none.

    Each run without one writes its own under a name of its own, and the first claim decides for all, so later runs, whatever their
    cells, and runs at the same time read the same files.
    """
    name = store.text("universe/first")
    if name is None:
        mine = f"universe/{uuid.uuid4().hex}"
        describe().write.parquet(store.at(mine))
        store.claim("universe/first", mine)
        name = store.text("universe/first")
    return store.spark.read.parquet(store.at(name))
