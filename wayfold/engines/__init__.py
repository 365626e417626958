"""Engines that turn motion samples into places. :mod:`wayfold.engines.registry` runs them."""
