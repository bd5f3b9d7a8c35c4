"""Where data comes from and goes to: posts, the index store, options, and the language model port."""
