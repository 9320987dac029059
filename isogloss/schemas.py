"""Schemas of the library's tables. Matrices are long: one row per cell; a missing distance is null."""

RECORDING = "path string, village_key string, word string, content binary"
WAVEFORM = "path string, village_key string, word string, rate int, waveform array<float>"
FRAMES = "model string, layer int, village string, word string, recording string, frames array<array<float>>"
GOLD = "locality string, label int"
COORDINATES = "locality string, longitude double, latitude double"
