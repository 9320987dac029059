"""Column functions."""

from .columns import contains, file_stem, ground_distance, natural_key, not_a_number_to_null, partition_name, path_part, round_half_even, without_ending, zero_padded

__all__ = ["contains", "file_stem", "ground_distance", "natural_key", "not_a_number_to_null", "partition_name", "path_part", "round_half_even", "without_ending", "zero_padded"]
