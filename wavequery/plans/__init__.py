"""Tasks, prompts, configuration and the model runner."""
