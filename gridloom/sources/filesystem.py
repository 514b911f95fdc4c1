"""Host files of the driver: folders, paths, handles. Return codes are 1.0 and 0.0."""

from __future__ import annotations

import os
import shutil
import time
from pathlib import Path


def _code(act) -> float:
    try:
        act()
        return 1.0
    except OSError:
        return 0.0


def dir_(path: str = ".") -> list[dict]:
    """name, folder, date, bytes, isdir of the entries, . and .. included, by name."""
    out = []
    for name in [".", "..", *sorted(os.listdir(path))]:
        s = os.stat(os.path.join(path, name))
        out.append({"name": name, "folder": path, "date": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(s.st_mtime)), "bytes": float(s.st_size), "isdir": os.path.isdir(os.path.join(path, name))})
    return out


mkdir = lambda p: _code(lambda: os.mkdir(p, 0o755))
rmdir = lambda p: _code(lambda: os.rmdir(p))
pwd = os.getcwd
cd = lambda p: _code(lambda: os.chdir(p))
fullfile = lambda *parts: os.path.join(*parts)
filesep = lambda: os.sep
exist = lambda p: float(os.path.exists(p))
exists = exist
isfile = lambda p: float(os.path.isfile(p))
isfolder = lambda p: float(os.path.isdir(p))
isdir = isfolder
deletefile = lambda p: _code(lambda: os.remove(p))
rmfile = deletefile
copyfile = lambda a, b: _code(lambda: shutil.copyfile(a, b))
movefile = lambda a, b: _code(lambda: shutil.move(a, b))


def fileparts(path: str) -> dict[str, str]:
    p = Path(path)
    return {"path": str(p.parent) if p.parent != Path(".") or path.startswith(".") else "", "name": p.stem, "ext": p.suffix, "filename": p.name}


class FileHandle:
    """A driver file; bulk data goes through the readers instead."""

    def __init__(self, path: str, mode: str = "r"):
        self.path, self.file = path, open(path, mode)  # noqa: SIM115

    def fprintf(self, fmt: str, *args) -> int:
        return self.file.write(c_format(fmt, *args))

    def fscanf(self) -> list[float]:
        """All numbers that are left in the file."""
        out = []
        for token in self.file.read().split():
            try:
                out.append(float(token))
            except ValueError:
                continue
        return out

    def fclose(self) -> float:
        self.file.close()
        return 0.0


fopen = FileHandle


def c_format(fmt: str, *args) -> str:
    """C formatting with width and precision; whole-number conversions truncate; the format repeats while arguments remain."""
    import re

    fmt = fmt.replace("\\n", "\n").replace("\\t", "\t")
    kinds = [k for k in re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([diuoxXeEfgGcs%])", fmt) if k != "%"]
    fmt = re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)[iu]", r"\1d", fmt)
    if not kinds:
        return fmt.replace("%%", "%")
    out, rest = "", list(args)
    while True:
        now, rest = rest[: len(kinds)], rest[len(kinds) :]
        if len(now) < len(kinds):
            now += [0 if k in "diuoxXeEfgG" else "" for k in kinds[len(now) :]]
        cast = [int(float(a)) if k in "diuoxX" else float(a) if k in "eEfgG" else (chr(int(a)) if k == "c" and not isinstance(a, str) else a) for a, k in zip(now, kinds, strict=True)]
        out += fmt % tuple(f"{c:.6g}" if k == "s" and isinstance(c, float) else c for c, k in zip(cast, kinds, strict=True))
        if not rest:
            return out
