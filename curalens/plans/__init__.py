"""plans of curalens: every module registers its queries in catalogue."""

from . import audits, catalogue, conversations, scoring

__all__ = ["audits", "catalogue", "conversations", "scoring"]
