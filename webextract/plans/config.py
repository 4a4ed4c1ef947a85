"""Settings from the environment and the command line; bad values fall back."""

from __future__ import annotations

import logging
import os
import shutil
import tarfile
import zipfile
from collections.abc import Mapping
from pathlib import Path

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def as_bool(value: str | None, default: bool) -> bool:
    v = (value or "").strip().lower()
    return True if v in TRUE else False if v in FALSE else default


def as_int(value: str | None, default: int, least: int | None = None, most: int | None = None) -> int:
    try:
        n = int((value or "").strip())
    except ValueError:
        return default
    return default if (least is not None and n < least) or (most is not None and n > most) else n


def as_float(value: str | None, default: float, least: float | None = None) -> float:
    try:
        x = float((value or "").strip())
    except ValueError:
        return default
    return default if least is not None and x < least else x


def as_level(value: str | int | None, default: str = "INFO") -> str:
    """A log level by its name or number."""
    v = str(value if value is not None else "").strip().upper()
    if v.isdigit():
        v = logging.getLevelName(int(v))
    return v if v in ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG") else {"WARN": "WARNING", "FATAL": "CRITICAL"}.get(v, default)


def as_format(value: str | None, default: str = "json") -> str:
    """json or text."""
    v = (value or "").strip().lower()
    return v if v in ("json", "text") else default


def first_set(env: Mapping[str, str], *names: str) -> str | None:
    """First value that is not blank, of each name in upper and then lower case."""
    return next((v.strip() for n in names for k in (n.upper(), n.lower()) if (v := env.get(k)) and v.strip()), None)


def proxies(env: Mapping[str, str], given: str | None = None, base: str | None = None) -> dict[str, str]:
    """Proxy of each scheme: the given one, the base's, the scheme's own variable, then that for all."""
    out = {}
    for scheme in ("http", "https"):
        v = given or base or first_set(env, f"{scheme}_proxy", "all_proxy")
        if v:
            out[scheme] = v
    return out


def bypass_list(env: Mapping[str, str], *more: str) -> list[str]:
    """Hosts that go without a proxy: given ones, then those of NO_PROXY, each once."""
    listed = [x.strip() for part in (*more, first_set(env, "no_proxy") or "") for x in part.split(",")]
    return list(dict.fromkeys(x for x in listed if x))


def check_output_dir(path: str, create: bool = True) -> None:
    """Raise unless ``path`` is, or can be made, a folder that can be written."""
    p = Path(path)
    if p.exists() and not p.is_dir():
        raise ValueError(f"{path} is not a folder")
    if not p.exists():
        if not create:
            raise ValueError(f"{path} does not exist")
        p.mkdir(parents=True)
    if not os.access(p, os.W_OK):
        raise ValueError(f"{path} cannot be written")


def purge(path: str) -> Path:
    """Empty a folder of stored state: it is deleted, with all it holds, and made anew."""
    p = Path(path).expanduser()
    if p.exists():
        shutil.rmtree(p)
    p.mkdir(parents=True)
    return p


# What has no place in a package.
BANNED_SUFFIXES = (".pth", ".so", ".dylib", ".dll", ".exe", ".bat", ".cmd", ".ps1")
BANNED_NAMES = ("sitecustomize.py", "usercustomize.py")


def check_archive(path: str, package: str = "webextract") -> list[str]:
    """What is wrong with a wheel or a source archive: members that are banned, or outside the package in a wheel."""
    if path.endswith(".whl"):
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
    elif path.endswith(".tar.gz"):
        with tarfile.open(path, "r:gz") as t:
            names = [m.name.split("/", 1)[-1] for m in t.getmembers() if m.isfile()]
    else:
        return [f"unsupported distribution type: {path}"]
    out = []
    for n in names:
        top, last = n.split("/")[0], n.rsplit("/", 1)[-1]
        if last in BANNED_NAMES:
            out.append(f"banned file name: {n}")
        elif last.lower().endswith(BANNED_SUFFIXES):
            out.append(f"banned file suffix: {n}")
        elif path.endswith(".whl") and top != package and not top.endswith(".dist-info"):
            out.append(f"unexpected top-level entry: {n}")
    return out


def has_space(path: str, least_mb: int = 100) -> bool:
    """Whether the disk has room; true where that cannot be known."""
    try:
        return shutil.disk_usage(path).free >= least_mb * 1024 * 1024
    except OSError:
        return True
