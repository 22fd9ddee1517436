import os
import sys

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers
sys.path.insert(0, ROOT)
