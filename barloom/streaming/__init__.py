"""Live bars: features of one bar after another, with the last bar published again and again until it closes."""
