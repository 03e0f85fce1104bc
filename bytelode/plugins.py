"""Formats, directory formats and report types of one's own.

A plug-in is a module with a function ``formats()`` that gives formats and directory formats (``Parts``), and, where it has types of reports,
a function ``report_types()`` that gives {name: fields}; it is found as a file, as the modules of a folder, or by
the entry point group ``bytelode``.
"""

from __future__ import annotations

import importlib.metadata
import importlib.util
import sys
from pathlib import Path

from bytelode.formats import Format
from bytelode.operators.multifile import Parts

GROUP = "bytelode"


class PluginError(ImportError):
    """A plug-in can't be loaded, or gives what isn't a format."""


def load(path: str | Path) -> tuple[Format, ...]:
    """Formats of a module's file, or of all modules of a folder in order of name."""
    path = Path(path)
    if path.is_dir():
        return tuple(f for p in sorted(path.glob("*.py")) if not p.name.startswith("_") for f in load(p))
    name = f"bytelode_plugin_{path.stem}"
    spec = importlib.util.spec_from_file_location(name, path)
    if spec is None or spec.loader is None:
        raise PluginError(str(path))
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
        from bytelode.plans import reports

        for kind, fields in getattr(module, "report_types", dict)().items():
            reports.register(kind, tuple(fields))
        return checked(module.formats(), str(path))
    except Exception as e:
        raise PluginError(f"{path}: {e}") from e


def installed() -> tuple[Format, ...]:
    """Formats of installed packages."""
    return tuple(f for e in importlib.metadata.entry_points(group=GROUP) for f in checked(e.load()(), e.name))


def checked(found, where: str) -> tuple[Format, ...]:
    found = tuple(found)
    if not all(isinstance(f, (Format, Parts)) for f in found):
        raise PluginError(f"{where} gives what isn't a format")
    return found
