"""Part of fluxweave; see the README."""
