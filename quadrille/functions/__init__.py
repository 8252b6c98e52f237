"""Terms, texts and draws: what the operators compute with."""
