"""Part of the tripleloom engine."""
