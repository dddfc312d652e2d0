"""Running statistics over streams of frames."""
