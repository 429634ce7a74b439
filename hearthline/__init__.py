"""Hearthline: PySpark jobs that screen, judge, enrich and de-duplicate feeds of free-text rental listings."""

from hearthline.params import RulePack, ScreenParams

__all__ = ["RulePack", "ScreenParams"]
