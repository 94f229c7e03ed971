"""Storage usage: roll-ups, histograms, prefixes."""
