"""Reports put together from operators, and named presets."""
